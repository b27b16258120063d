"""Temporal and spatial joins: by rounded time, by interval, as-of, nearest, by cell.

Every join has an equality in its condition: the group key, and where the rest
is a range, a bucket of it, so that Spark hashes or sorts and never compares
all rows with all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EARTH_M_PER_DEGREE, distance_3d, flat_metres, half_even, iou_2d, span_overlap
from .cells import SLACK, unit


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with a prefix, so that both sides of a join keep their names."""
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in (columns or df.columns)])


def cotime_pairs(samples: DataFrame, keys: Sequence[str] = ("mission_id",), subject: str = "subject_id") -> DataFrame:
    """Ordered pairs of different subjects at one rounded time (l_..., r_...)."""
    rows = samples.withColumn("at", half_even(F.col("t_sec"), 6))
    left, right = prefixed(rows, "l_"), prefixed(rows, "r_")
    same = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in (*keys, "at")]
    return left.join(right, [*same, F.col(f"l_{subject}") != F.col(f"r_{subject}")])


def buckets(start: Column, end: Column, width: float) -> Column:
    """Numbers of the buckets that an interval touches."""
    return F.sequence(F.floor(start / width), F.floor(end / width))


def points_in_intervals(intervals: DataFrame, points: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Pairs with ``start_sec <= p_t_sec < end_sec``; point columns get ``p_``.

    Intervals are dealt to the time buckets that they touch and points to theirs.
    """
    left = intervals.withColumn("bucket", F.explode(buckets(F.col("start_sec"), F.col("end_sec"), width)))
    right = prefixed(points, "p_").withColumn("p_bucket", F.floor(F.col("p_t_sec") / width))
    same = [F.col(k) == F.col(f"p_{k}") for k in keys]
    return left.join(right, [*same, F.col("bucket") == F.col("p_bucket"), F.col("start_sec") <= F.col("p_t_sec"), F.col("p_t_sec") < F.col("end_sec")]).drop("bucket", "p_bucket")


def last_in_interval(intervals: DataFrame, points: DataFrame, keys: Sequence[str], row_id: str, tie: str, width: float = 8.0) -> DataFrame:
    """The last point of each interval: (row_id, last_t, last_id); null without one."""
    met = points_in_intervals(intervals.select(row_id, *keys, "start_sec", "end_sec"), points.select(*keys, "t_sec", tie), keys, width)
    best = met.groupBy(F.col(row_id).alias("of")).agg(F.max(F.struct("p_t_sec", f"p_{tie}")).alias("best"))
    return intervals.select(row_id).join(best, F.col(row_id) == F.col("of"), "left").select(row_id, F.col("best.p_t_sec").alias("last_t"), F.col(f"best.p_{tie}").alias("last_id"))


def motion_in(intervals: DataFrame, points: DataFrame, keys: Sequence[str], row_id: str, width: float = 8.0) -> DataFrame:
    """Displacement between the first and the last point of each interval."""
    met = points_in_intervals(intervals.select(row_id, *keys, "start_sec", "end_sec"), points.select(*keys, "t_sec", "cx", "cy", "cz"), keys, width)
    at = F.struct("p_cx", "p_cy", "p_cz")
    ends = met.groupBy(row_id).agg(F.min_by(at, "p_t_sec").alias("a"), F.max_by(at, "p_t_sec").alias("z"), F.count("*").alias("n"))
    part = lambda s: tuple(F.col(f"{s}.p_{c}") for c in ("cx", "cy", "cz"))
    return ends.select(row_id, "n", distance_3d(part("a"), part("z")).alias("moved_m"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: str, right_id: str, tolerance: float) -> DataFrame:
    """The right row nearest in time to each left row, within a tolerance.

    Right rows, one for each time, are dealt to the buckets that they reach, and
    one window over both sides in each direction finds the neighbours of a left
    row; a bucket's rows never meet in pairs.  Ties go to the earlier time and
    then the lesser id.
    """
    width = 64 * tolerance
    times = right.filter(F.col("t_sec").isNotNull()).groupBy(*keys, "t_sec").agg(F.min(right_id).alias("near_id"))
    reach = F.sequence(F.floor((F.col("t_sec") - 2 * tolerance) / width), F.floor((F.col("t_sec") + 2 * tolerance) / width))
    row = F.struct(F.col("t_sec").alias("t"), F.col("near_id").alias("id"))
    b = times.select(*keys, F.explode(reach).alias("bucket"), "t_sec", F.lit(0).alias("side"), F.lit(None).cast(left.schema[row_id].dataType).alias(row_id), row.alias("row"))
    a = left.filter(F.col("t_sec").isNotNull()).select(*keys, F.floor(F.col("t_sec") / width).alias("bucket"), "t_sec", F.lit(1).alias("side"), row_id, F.lit(None).cast(b.schema["row"].dataType).alias("row"))
    part = Window.partitionBy(*keys, "bucket")
    upto = part.orderBy("t_sec", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = part.orderBy(F.desc("t_sec"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("low", F.last("row", ignorenulls=True).over(upto)).withColumn("high", F.last("row", ignorenulls=True).over(after)).filter("side = 1")
    for k in keys:
        both = both.filter(F.col(k).isNotNull())
    rank = lambda r: F.when(F.col(r).isNotNull(), F.struct(F.abs(F.col("t_sec") - F.col(f"{r}.t")).alias("off"), F.col(f"{r}.t").alias("t"), F.col(f"{r}.id").alias("id")))
    met = both.withColumn("best", F.least(rank("low"), rank("high"))).filter(F.col("best.off") <= tolerance)
    return met.groupBy(row_id).agg(F.min("best").alias("best")).select(row_id, F.col("best.off").alias("off"), F.col("best.id").alias("nearest_id"))


def asof(queries: DataFrame, states: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-6, strict: bool = False) -> DataFrame:
    """The latest state at or before each query's time, or with ``strict`` before it.

    One union and one window: states carry a value, queries none, and the last
    value before a query is its answer.  Both sides share one shuffle by key.
    """
    value = F.struct(*[F.col(c) for c in columns])
    s = states.select(*keys, F.col("t_sec").alias("sort_t"), F.lit(0).alias("side"), value.alias("state"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("double").alias("t_sec"))
    q = queries.select(*keys, (F.col("t_sec") + tolerance).alias("sort_t"), F.lit(-1 if strict else 1).alias("side"), F.lit(None).cast(s.schema["state"].dataType).alias("state"), "query_id", "t_sec")
    window = Window.partitionBy(*keys).orderBy("sort_t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.unionByName(q).withColumn("state", F.last("state", ignorenulls=True).over(window)).filter("side <> 0").select("query_id", *keys, "t_sec", *[F.col(f"state.{c}").alias(c) for c in columns])


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float = 8.0, how: str = "inner") -> DataFrame:
    """Pairs of half-open intervals that overlap; right columns get ``r_``.

    Each side goes to the buckets it touches; a pair is taken in the bucket where
    the later one starts, so once.  ``left_semi`` gives the left rows that have one.
    """
    a = left.withColumn("bucket", F.explode(buckets(F.col("start_sec"), F.col("end_sec"), width)))
    b = prefixed(right, "r_").withColumn("r_bucket", F.explode(buckets(F.col("r_start_sec"), F.col("r_end_sec"), width)))
    first = F.floor(F.greatest("start_sec", "r_start_sec") / width)
    on = [*[F.col(k) == F.col(f"r_{k}") for k in keys], F.col("bucket") == F.col("r_bucket"), F.col("bucket") == first, F.col("start_sec") < F.col("r_end_sec"), F.col("r_start_sec") < F.col("end_sec")]
    if how == "left_semi":
        return a.join(b, on, "left_semi").drop("bucket").distinct()
    return a.join(b, on).drop("bucket", "r_bucket")


def nearest_start(queries: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(event_id, near_id, near_start): the row whose start is nearest, of equals the least id.

    One window over both sides in each direction; a key's rows never meet in pairs.
    """
    none = F.lit(None).cast(rows.schema["event_id"].dataType)
    a = queries.select(*keys, "start_sec", F.lit(1).alias("side"), F.col("event_id").alias("asks"), F.lit(None).cast("struct<s:double,id:bigint>").alias("row"))
    row = F.struct(F.col("start_sec").alias("s"), F.col("least").alias("id"))
    b = rows.groupBy(*keys, "start_sec").agg(F.min("event_id").alias("least")).select(*keys, "start_sec", F.lit(0).alias("side"), none.alias("asks"), row.alias("row"))
    both = a.unionByName(b)
    upto = Window.partitionBy(*keys).orderBy("start_sec", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy(F.desc("start_sec"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("low", F.last("row", ignorenulls=True).over(upto)).withColumn("high", F.last("row", ignorenulls=True).over(after)).filter("side = 1")
    rank = lambda r: F.when(F.col(r).isNotNull(), F.struct(F.abs(F.col(f"{r}.s") - F.col("start_sec")).alias("off"), F.col(f"{r}.id").alias("id"), F.col(f"{r}.s").alias("s")))
    return both.withColumn("best", F.least(rank("low"), rank("high"))).select(F.col("asks").alias("event_id"), F.col("best.id").alias("near_id"), F.col("best.s").alias("near_start"))


def superseded_events(deep: DataFrame, fast: DataFrame) -> DataFrame:
    """For each deep event the fast one of its type that it replaces; null where there is none.

    Of the fast events that share its participant, or where none does of all, the
    one with the longest overlap; where none overlaps, the shared one with the
    nearest start.  Events with a participant of their own and no overlap replace
    none.  Ties go to the least id.
    """
    keys = ["mission_id", "type", "participant"]
    shared = nearest_start(deep, fast, keys).filter("near_id is not null").select(F.col("event_id").alias("of"), "near_id")

    def longest(on: Sequence[str]) -> DataFrame:
        met = overlaps(deep, fast.select("mission_id", "type", "participant", "event_id", "start_sec", "end_sec"), on)
        span = span_overlap(F.col("start_sec"), F.col("end_sec"), F.col("r_start_sec"), F.col("r_end_sec"))
        return met.groupBy(F.col("event_id").alias("of")).agg(F.min(F.struct((-span).alias("span"), F.col("r_event_id").alias("id"))).getField("id").alias("id"))

    same, any_ = longest(keys).select(F.col("of").alias("s_of"), F.col("id").alias("s_id")), longest(keys[:2]).select(F.col("of").alias("a_of"), F.col("id").alias("a_id"))
    met = deep.join(shared, F.col("event_id") == F.col("of"), "left").join(same, F.col("event_id") == F.col("s_of"), "left").join(any_, F.col("event_id") == F.col("a_of"), "left")
    return met.select("event_id", F.when(F.col("near_id").isNotNull(), F.coalesce("s_id", "near_id")).otherwise(F.col("a_id")).alias("replaces"))


def link_profiles(fast: DataFrame, deep: DataFrame) -> DataFrame:
    """Deep observations with the last fast one at their rounded time and label."""
    key = lambda df: df.withColumn("at", half_even(F.col("t_sec"), 3))
    last = key(fast).groupBy(F.col("mission_id").alias("f_m"), F.col("at").alias("f_at"), F.col("label").alias("f_l")).agg(F.max("observation_id").alias("replaces"))
    return key(deep).join(last, (F.col("mission_id") == F.col("f_m")) & (F.col("at") == F.col("f_at")) & (F.col("label") == F.col("f_l")), "left").select("observation_id", "mission_id", "t_sec", "label", "replaces")


def check_refs(references: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Dangling references: (kind, id, n) for each kind's (rows, column, table, id column).

    Of each kind references and known ids, which may repeat, are counted by one grouping.
    """
    found = None
    for kind, (rows, column, table, key) in references.items():
        wanted = rows.select(F.col(column).cast("string").alias("id"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("known"))
        known = table.select(F.col(key).cast("string").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("known"))
        each = wanted.unionByName(known).filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"), F.max("known").alias("known"))
        issues = each.filter("n > 0 and not known").select(F.lit(kind).alias("kind"), "id", "n")
        found = issues if found is None else found.unionByName(issues)
    return found


def _columns_of(row: Column, step: float) -> Column:
    """Cells of a row of the grid: at least as wide as the step, also at the far edges of both neighbour rows."""
    widest = F.least(F.greatest(F.abs((row - 1) * step), F.abs((row + 2) * step)), F.lit(89.9))
    return F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(widest)) / step), F.lit(1))


def geo_cell(lat: Column, lon: Column, metres: float) -> tuple[Column, Column]:
    """(row, column) of a grid over the globe whose cells are at least ``metres`` wide and high at any latitude."""
    step = metres / EARTH_M_PER_DEGREE
    row = F.floor(lat / step)
    n = _columns_of(row, step)
    return row, F.pmod(F.floor((lon + 180.0) / 360.0 * n), n)


def geo_cells_near(lat: Column, lon: Column, metres: float) -> Column:
    """Array of the (row, column) cells that hold all points within ``metres``: three rows, each as far as it reaches, over the date line too."""
    step = metres / EARTH_M_PER_DEGREE
    here = F.floor(lat / step)

    def cells(row: Column) -> Column:
        n = _columns_of(row, step)
        column = F.floor((lon + 180.0) / 360.0 * n)
        return F.transform(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column + d, n))), lambda c: F.struct(row.alias("row"), c.alias("column")))

    return F.concat(cells(here - 1), cells(here), cells(here + 1))


def around(cell: Column) -> Column:
    """A cell number and its two neighbours."""
    return F.array(cell - 1, cell, cell + 1)


def assign_sites(missions: DataFrame, sites: DataFrame, within_m: float = 5_000.0) -> DataFrame:
    """The nearest site within a distance; a mission without one gets a new site by cell.

    Places of missions meet the places of sites in their own cell and its
    neighbours only, so many missions and sites at one place meet once.
    """
    row, column = geo_cell(F.col("lat"), F.col("lon"), within_m)
    m = missions.select("mission_id", "lat", "lon", row.alias("row"), column.alias("column"))
    places = m.select("lat", "lon", "row", "column").distinct()
    s = sites.groupBy(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).agg(F.min("site_id").alias("near_id"))
    s = s.select("near_id", "s_lat", "s_lon", F.explode(geo_cells_near(F.col("s_lat"), F.col("s_lon"), within_m)).alias("s"))
    met = places.join(s, (F.col("row") == F.col("s.row")) & (F.col("column") == F.col("s.column")))
    met = met.withColumn("off", flat_metres(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))).filter(F.col("off") <= within_m)
    best = met.groupBy(F.col("lat").alias("of_lat"), F.col("lon").alias("of_lon")).agg(F.min(F.struct("off", "near_id")).alias("best"))
    new = F.concat_ws(":", F.lit("new"), F.col("row").cast("string"), F.col("column").cast("string"))
    return m.join(best, (F.col("lat") == F.col("of_lat")) & (F.col("lon") == F.col("of_lon")), "left").select("mission_id", F.coalesce(F.col("best.near_id").cast("string"), new).alias("site"), F.col("best.off").alias("distance_m"))


def detect_changes(points: DataFrame, radius_m: float, threshold: float, vector: str = "embedding") -> DataFrame:
    """Frames whose nearest frame of another mission near by looks different.

    (id, reference, distance): of the frames of other missions within the radius
    the most alike, where its cosine distance is above the threshold.  Frames of a
    cell meet those of its neighbourhood in slices; pairs are never rows.
    """
    row, column = geo_cell(F.col("lat"), F.col("lon"), radius_m)
    here = points.dropna(subset=["id", "mission_id", "lat", "lon", vector]).select("id", "mission_id", "lat", "lon", F.cos(F.radians("lat")).alias("cos"), F.col(vector).alias("v"))
    left = here.drop("cos").withColumn("cell", F.struct(row.cast("long").alias("row"), column.cast("long").alias("column")))
    right = here.withColumn("cell", F.explode(geo_cells_near(F.col("lat"), F.col("lon"), radius_m))).withColumn("cell", F.struct(F.col("cell.row").cast("long").alias("row"), F.col("cell.column").cast("long").alias("column")))
    number = lambda df, name, size: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    slices = number(left, "l_slices", FRAME_SLICE).join(number(right, "r_slices", REFERENCE_SLICE), "cell")  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = left.join(slices, "cell").select(F.col("cell").alias("cell"), mine("l_slices").alias("l"), every("r_slices").alias("r"), *[F.col(c).alias(c) for c in ("id", "mission_id", "lat", "lon", "v")])
    right = right.join(slices, "cell").select(F.col("cell").alias("cell"), every("l_slices").alias("l"), mine("r_slices").alias("r"), *[F.col(c).alias(c) for c in ("id", "mission_id", "lat", "lon", "cos", "v")])
    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = f"id {kind['id']}, distance double, r_id {kind['id']}"
    met = left.groupBy("cell", "l", "r").cogroup(right.groupBy("cell", "l", "r")).applyInPandas(lambda a, b: most_alike(a, b, radius_m), schema)
    best = met.groupBy("id").agg(F.min(F.struct("distance", "r_id")).alias("best"))
    return best.filter(F.col("best.distance") > threshold).select("id", F.col("best.r_id").alias("reference"), F.col("best.distance").alias("distance"))


#: Frames and references of a cell that meet in one task, and frames that are compared at once.
FRAME_SLICE, REFERENCE_SLICE, TILE = 16_384, 32_768, 64


def most_alike(frames: pd.DataFrame, near: pd.DataFrame, radius_m: float) -> pd.DataFrame:
    """(id, distance, r_id): for each frame the most alike one of another mission within the radius, if one is there; ties by id.

    Products in single precision leave the few that can be it, which are worked out in double precision.
    """
    names, rows = ["id", "distance", "r_id"], []
    near = near.sort_values("id", kind="stable")
    if len(frames) and len(near):
        x, y = unit(near["v"]), unit(frames["v"])
        near, frames = near[x.any(axis=1)], frames[y.any(axis=1)]
        x, y = x[x.any(axis=1)], y[y.any(axis=1)]
        x32, ids, mission = np.ascontiguousarray(x.T.astype(np.float32)), near["id"].to_numpy(), near["mission_id"].to_numpy()
        lat, lon, cos = (near[c].to_numpy(np.float64) for c in ("lat", "lon", "cos"))
        for first in range(0, len(frames), TILE):
            some = frames.iloc[first : first + TILE]
            column = lambda c: some[c].to_numpy()[:, None]  # noqa: B023, E731
            north, apart = (column("lat") - lat) * EARTH_M_PER_DEGREE, column("lon") - lon
            east = np.where(np.abs(apart) > 180, apart - np.sign(apart) * 360, apart) * EARTH_M_PER_DEGREE * cos
            ok = (np.sqrt(north * north + east * east) <= radius_m) & (column("mission_id") != mission)
            like = np.where(ok, y[first : first + TILE].astype(np.float32) @ x32, -np.inf)
            most = like.max(axis=1) if like.shape[1] else np.full(len(some), -np.inf)
            reach = like >= (most - SLACK)[:, None]
            for i in np.flatnonzero(np.isfinite(most)):
                found = np.flatnonzero(reach[i])
                distance = np.round(1.0 - x[found] @ y[first + i], 9)
                k = distance.argmin()
                rows.append((some["id"].iloc[i], distance[k], ids[found[k]]))
    return pd.DataFrame(rows, columns=names)


def enrich_by_time(frames: DataFrame, samples: DataFrame, digits: int = 3) -> DataFrame:
    """Frames with the value of the last sample at their rounded time."""
    last = samples.withColumn("at", half_even(F.col("t_sec"), digits)).groupBy(F.col("mission_id").alias("s_m"), F.col("at").alias("s_at")).agg(F.max_by("value", "packet_id").alias("value"))
    return frames.withColumn("at", half_even(F.col("t_sec"), digits)).join(last, (F.col("mission_id") == F.col("s_m")) & (F.col("at") == F.col("s_at")), "left").drop("s_m", "s_at", "at")


def apply_poses(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Frames with the registered poses of their ids; others stay as they are."""
    new = poses.select(F.col("frame_id").alias("posed"), F.col("pose").alias("new_pose"))
    return frames.join(new, F.col("frame_id") == F.col("posed"), "left").withColumn("pose", F.coalesce("new_pose", "pose")).drop("posed", "new_pose")


def subtitles(frames: DataFrame, segments: DataFrame, window: float, width: float = 8.0) -> DataFrame:
    """Text of the segments within a window of each frame, in order of start."""
    wide = segments.withColumn("start_sec", F.col("start_sec") - window).withColumn("end_sec", F.col("end_sec") + window + 1e-9)
    met = points_in_intervals(wide, frames.select("mission_id", "t_sec", "frame_id"), ["mission_id"], width)
    text = met.groupBy(F.col("p_frame_id").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "text"))), lambda s: s["text"]), " ").alias("subtitle"))
    return frames.join(text, F.col("frame_id") == F.col("of"), "left").select("frame_id", "subtitle")


def label_masks(masks: DataFrame, detections: DataFrame, least_iou: float = 0.1) -> DataFrame:
    """Each mask's label: that of the detection of its frame with the best overlap."""
    d = prefixed(detections, "d_")
    box = lambda p: tuple(F.col(f"{p}{c}") for c in "xywh")
    met = masks.join(d, (F.col("mission_id") == F.col("d_mission_id")) & (F.col("t_sec") == F.col("d_t_sec"))).withColumn("iou", F.round(iou_2d(box(""), box("d_")), 9))
    best = met.groupBy(F.col("mission_id").alias("m"), F.col("mask_id").alias("k"), F.col("t_sec").alias("t")).agg(F.max(F.struct("iou", "d_label")).alias("best"))
    found = masks.join(best, (F.col("mission_id") == F.col("m")) & (F.col("mask_id") == F.col("k")) & (F.col("t_sec") == F.col("t")), "left")
    return found.select("mission_id", "mask_id", "t_sec", F.when(F.col("best.iou") >= least_iou, F.col("best.d_label")).otherwise("unlabeled").alias("label"))


def scene_overlap(scenes: DataFrame, largest_radius: float) -> DataFrame:
    """Pairs of scenes nearer than the sum of their radii (x, y, radius), each once.

    Cells of twice the largest radius bring together all that can overlap.
    """
    step = 2 * largest_radius
    rows = scenes.withColumn("row", F.floor(F.col("x") / step)).withColumn("column", F.floor(F.col("y") / step))
    other = prefixed(rows, "r_").withColumn("r_row", F.explode(around(F.col("r_row")))).withColumn("r_column", F.explode(around(F.col("r_column"))))
    met = rows.join(other, (F.col("row") == F.col("r_row")) & (F.col("column") == F.col("r_column")) & (F.col("scene_id") < F.col("r_scene_id")))
    far = F.sqrt((F.col("x") - F.col("r_x")) ** 2 + (F.col("y") - F.col("r_y")) ** 2)
    return met.withColumn("distance", far).filter(F.col("distance") < F.col("radius") + F.col("r_radius")).select("scene_id", "r_scene_id", "distance")


def apply_annotations(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames newly annotated: labels meet them by the file name at the path's end."""
    named = labels.select(F.regexp_extract("file", r"[^/]+$", 0).alias("name"), F.col("label").alias("new_label"))
    rows = frames.withColumn("name", F.regexp_extract("frame_path", r"[^/]+$", 0))
    return rows.join(named, "name").filter(F.col("cvat_label").isNull()).select("frame_id", "new_label")


def evidence(cited: DataFrame, geometry: DataFrame, masks: DataFrame, tolerance: float) -> DataFrame:
    """Stored geometry and masks that cited events stand on: (event_id, sample_id, mask_id), one of both null.

    Cited events have (event_id, mission_id, participant, start_sec); rows of the
    participant within the tolerance of the start belong to them.  An event
    without any has one row of nulls.
    """
    def near(rows: DataFrame, subject: str, row_id: str) -> DataFrame:
        s = rows.select("mission_id", F.col(subject).alias("participant"), "t_sec", F.col(row_id).alias("row_id"))
        wide = cited.select("event_id", "mission_id", "participant", (F.col("start_sec") - tolerance).alias("start_sec"), (F.col("start_sec") + tolerance + 1e-9).alias("end_sec"))
        return points_in_intervals(wide, s, ["mission_id", "participant"], max(8 * tolerance, 1e-3)).select(F.col("event_id").alias("of"), F.col("p_row_id").cast("string").alias("row_id"))

    none = F.lit(None).cast("string")
    found = near(geometry, "subject_id", "sample_id").select("of", F.col("row_id").alias("sample_id"), none.alias("mask_id")).unionByName(near(masks, "track_id", "mask_id").select("of", none.alias("sample_id"), F.col("row_id").alias("mask_id")))
    return cited.select("event_id").join(found, F.col("event_id") == F.col("of"), "left").select("event_id", "sample_id", "mask_id")


def answer_evidence(answers: DataFrame, events: DataFrame) -> DataFrame:
    """The events that answers (qa_id, evidence_event_ids) cite, each with the answer's id."""
    cites = answers.select("qa_id", F.explode("evidence_event_ids").alias("cited"))
    return cites.join(events, F.col("cited") == F.col("event_id")).select("qa_id", "event_id", "mission_id", "participant", "start_sec")


def precheck(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Incoming files (file_id, digest, url, size) against processed ones (id, digest, url, size, updated_at).

    (file_id, status, reason, existing): a file is looked up by its digest, if it
    has none by its url, and else by its size, where the latest of that size
    counts; one of which nothing is known can't be looked up.
    """
    latest = F.max(F.struct("updated_at", "id")).getField("id")
    rows = files
    for key in ("digest", "url", "size"):
        known = processed.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"of_{key}")).agg(latest.alias(f"by_{key}"))
        rows = rows.join(known, F.col(key) == F.col(f"of_{key}"), "left")
    reason = F.when(F.col("digest").isNotNull(), "hash").when(F.col("url").isNotNull(), "url").when(F.col("size").isNotNull(), "size").otherwise("hash_failed")
    existing = F.when(reason == "hash", F.col("by_digest")).when(reason == "url", F.col("by_url")).when(reason == "size", F.col("by_size"))
    status = F.when(reason == "hash_failed", "error").when(existing.isNotNull(), "duplicate").otherwise("new")
    return rows.select("file_id", status.alias("status"), reason.alias("reason"), existing.alias("existing"))


def both_names(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Rows under the name in a column and, once more, under its alias: of (mission_id, node_id, track_id) each names the other."""
    pair = aliases.filter("track_id is not null and node_id <> track_id").select(F.col("mission_id").alias("alias_m"), "node_id", "track_id").distinct()
    other = pair.select("alias_m", F.col("node_id").alias("alias_of"), F.col("track_id").alias("alias")).unionByName(pair.select("alias_m", F.col("track_id").alias("alias_of"), F.col("node_id").alias("alias")))
    met = rows.join(other, (F.col("mission_id") == F.col("alias_m")) & (F.col(column) == F.col("alias_of")))
    return rows.unionByName(met.withColumn(column, F.col("alias")).select(*rows.columns))


def supported_claims(claims: DataFrame, events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims (claim_id, mission_id, subject_id, start_sec, end_sec) that an accepted event with evidence bears out: (claim_id).

    Its interval overlaps the claim's, and a participant is the subject, as a node or as a track.
    """
    held = events.filter("status = 'accepted' and n_evidence > 0").select("mission_id", F.explode("participants").alias("subject_id"), "start_sec", "end_sec")
    asked = claims.filter("start_sec is not null and end_sec is not null and subject_id is not null").select("claim_id", "mission_id", "subject_id", "start_sec", "end_sec")
    met = overlaps(both_names(asked, "subject_id", aliases), both_names(held, "subject_id", aliases), ["mission_id", "subject_id"], how="left_semi")
    return met.select("claim_id").distinct()


def facts_diff(changes: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that differ between a changed frame and its reference: (id, reference, key, was, is).

    ``facts`` has (id, facts as a map); keys of one side alone are null on the other.
    """
    now, then = (facts.select(F.col("id").alias(f"{p}_id"), F.col("facts").alias(f"{p}_facts")) for p in ("n", "t"))
    met = changes.join(now, F.col("id") == F.col("n_id"), "left").join(then, F.col("reference") == F.col("t_id"), "left")
    empty = F.create_map().cast("map<string,string>")
    n, t = F.coalesce("n_facts", empty), F.coalesce("t_facts", empty)
    rows = met.select("id", "reference", n.alias("n"), t.alias("t"), F.explode(F.array_union(F.map_keys(n), F.map_keys(t))).alias("key"))
    rows = rows.select("id", "reference", "key", F.try_element_at("t", F.col("key")).alias("was"), F.try_element_at("n", F.col("key")).alias("is"))
    return rows.filter(~F.col("was").eqNullSafe(F.col("is")))


def georeference(observations: DataFrame, poses: DataFrame) -> DataFrame:
    """Places of observations: the pose at or before them plus the offset of the box's centre, inside the image, at its range."""
    met = asof(observations.withColumnRenamed("observation_id", "query_id").select("query_id", "mission_id", "t_sec"), poses, ["mission_id"], ["east", "north"])
    rows = observations.join(met.select(F.col("query_id").alias("q"), "east", "north"), F.col("observation_id") == F.col("q"))
    centre = lambda low, size: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(low) + F.col(size) / 2))
    return rows.select("observation_id", (F.col("east") + (centre("x", "w") - 0.5) * F.col("range_m")).alias("east_m"), (F.col("north") + (0.5 - centre("y", "h")) * F.col("range_m")).alias("north_m"))


def region_samples(regions: DataFrame, stamps: DataFrame) -> DataFrame:
    """Every region of a mission at each of its stamps; the first row of a repeated id wins."""
    once = regions.groupBy("mission_id", "region_id").agg(F.min_by(F.struct("cx", "cy", "cz"), "line").alias("at"))
    return once.join(stamps.select("mission_id", "t_sec").distinct(), "mission_id").select("mission_id", "region_id", "t_sec", "at.*")
