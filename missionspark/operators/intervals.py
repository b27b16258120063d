"""Series and intervals: relations over time, motion, changes, gaps."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import distance_3d
from ..sources.storage import materialise
from .joins import cotime_pairs

# Fixed values of the relation rules.
AXIS_TOLERANCE_M, CONTACT_GAP_M, MOVED_M, TAIL_SEC = 0.05, 0.05, 0.05, 1.0
BANDS = ((0.0, 2.0), (2.0, 8.0), (8.0, 32.0))
#: States of a track that is still there, seen or not.
ACTIVE = ("tentative", "confirmed", "occluded")
SYMMETRIC, METRIC = ("intersects", "contacts", "distance_band"), ("supports", "contacts", "distance_band")


def _box(p: str) -> tuple[list[Column], list[Column]]:
    """Lower and upper corner of a sample's axis-aligned box."""
    low = [F.col(f"{p}c{a}") - F.col(f"{p}e{a}") / 2 for a in "xyz"]
    return low, [F.col(f"{p}c{a}") + F.col(f"{p}e{a}") / 2 for a in "xyz"]


def predicates(left: str = "l_", right: str = "r_") -> dict[str, Column]:
    """When each geometric predicate holds between two samples, whose columns have these prefixes."""
    (ll, lh), (rl, rh) = _box(left), _box(right)
    every = lambda parts: functools.reduce(lambda x, y: x & y, parts)
    over = every([(ll[k] <= rh[k]) & (rl[k] <= lh[k]) for k in range(2)])
    touch = over & (F.abs(rl[2] - lh[2]) <= CONTACT_GAP_M)
    x, z = ((F.col(f"{left}c{a}"), F.col(f"{right}c{a}")) for a in "xz")
    return {
        "contains": every([(ll[k] <= rl[k]) & (rh[k] <= lh[k]) for k in range(3)]), "intersects": every([(ll[k] <= rh[k]) & (rl[k] <= lh[k]) for k in range(3)]),
        "left_of": x[0] + AXIS_TOLERANCE_M < x[1], "right_of": x[0] > x[1] + AXIS_TOLERANCE_M,
        "above": z[0] > z[1] + AXIS_TOLERANCE_M, "below": z[0] + AXIS_TOLERANCE_M < z[1],
        "supports": touch, "contacts": touch, "occludes": (F.col(f"{left}depth_m") + AXIS_TOLERANCE_M < F.col(f"{right}depth_m")) & over,
    }


def seen(samples: DataFrame, tracks: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Samples with ``seen`` (their subject is a track, active at the sample's time) and ``region``.

    Regions (mission_id, region_id) are those named, and subjects that are no track.
    """
    key, at = ["mission_id", "subject_id"], F.bround("t_sec", 6)
    named = tracks.select("mission_id", F.col("track_id").alias("subject_id"), at.alias("at"), F.lit(1).alias("kind"), F.col("state").isin(*ACTIVE).alias("active"))
    if regions is not None:
        named = named.unionByName(regions.select("mission_id", F.col("region_id").alias("subject_id"), F.lit(None).cast("double").alias("at"), F.lit(2).alias("kind"), F.lit(False).alias("active")))
    none = [F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in samples.columns if c not in key]
    rows = samples.withColumns({"at": at, "kind": F.lit(0), "active": F.lit(False)}).unionByName(named.select(*key, *none, "at", "kind", "active"))
    # One shuffle: all that is said of a subject meets its samples, in order of time.
    whole, then = Window.partitionBy(*key), Window.partitionBy(*key, "at")
    told = rows.withColumn("seen", F.max("active").over(then)).withColumn("track", F.max(F.col("kind") == 1).over(whole)).withColumn("named", F.max(F.col("kind") == 2).over(whole))
    # A sample without a mission, subject or time is seen by nothing.
    known = F.col("mission_id").isNotNull() & F.col("subject_id").isNotNull()
    seen = F.coalesce("seen", F.lit(False)) & known & F.col("at").isNotNull()
    return told.filter("kind = 0").select(*samples.columns, seen.alias("seen"), (~(F.col("track") & known) | F.col("named") & known).alias("region"))


#: Relations by the place of their bit: (predicate, band).
SLOTS = (*[(p, "") for p in ("contains", "intersects", "left_of", "right_of", "above", "below", "supports", "contacts", "occludes")], *[("distance_band", f"{low:.3f}-{high:.3f}") for low, high in BANDS], ("visible", ""))


def _slot(slot: Column, field: int) -> Column:
    """Predicate or band of a relation's place."""
    return F.get(F.array(*[F.lit(s[field]) for s in SLOTS]), slot)


def related(samples: DataFrame, tracks: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Which relations hold between two subjects at one time, as bits of ``held``: (mission_id, at, l_subject_id, r_subject_id, sample_id, held)."""
    columns = ["mission_id", "subject_id", "sample_id", "t_sec", *[f"{p}{a}" for p in "ce" for a in "xyz"], "depth_m", "metric_scale"]
    samples = samples.select(*columns) if tracks is None else seen(samples.select(*columns), tracks, regions)
    distance = distance_3d(tuple(F.col(f"l_c{a}") for a in "xyz"), tuple(F.col(f"r_c{a}") for a in "xyz"))
    metric = (F.col("l_metric_scale") == "metric") & (F.col("r_metric_scale") == "metric")
    once = F.col("l_subject_id") < F.col("r_subject_id")
    holds = {(p, ""): c & (once if p in SYMMETRIC else F.lit(True)) & (metric if p in METRIC else F.lit(True)) for p, c in predicates().items()}
    before = F.lit(False)
    for low, high in BANDS:
        within = (distance >= low) & (distance <= high)
        holds["distance_band", f"{low:.3f}-{high:.3f}"] = once & metric & within & ~before
        before = before | within
    if tracks is not None:
        holds["visible", ""] = F.col("l_seen") & F.col("r_region")
    held = functools.reduce(lambda x, y: x.bitwiseOR(y), [F.when(c, F.lit(1 << SLOTS.index(s))).otherwise(F.lit(0)) for s, c in holds.items()])
    return cotime_pairs(samples).select(F.col("l_mission_id").alias("mission_id"), F.col("l_at").alias("at"), "l_subject_id", "r_subject_id", F.col("l_sample_id").alias("sample_id"), held.alias("held"))


def _each(bits: dict[int, Column]) -> Column:
    """Explodes the places whose condition holds; null ones are to be filtered."""
    return F.explode(F.array(*[F.when(c, F.lit(k)) for k, c in bits.items()]))


def relations(samples: DataFrame, tracks: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Predicates that hold between two subjects at one time.

    (mission_id, at, l_subject_id, r_subject_id, predicate, band, sample_id, tick,
    next_at): tick numbers the pair's co-times, next_at is the following one.
    Symmetric ones are given once, metric ones where both samples are metric.
    With ``tracks``, an active track is visible from a region, see :func:`seen`.
    """
    order = Window.partitionBy("mission_id", "l_subject_id", "r_subject_id").orderBy("at", "sample_id")
    pairs = related(samples, tracks, regions).withColumn("tick", F.row_number().over(order)).withColumn("next_at", F.lead("at").over(order))
    found = pairs.withColumn("slot", _each({k: F.col("held").bitwiseAND(F.lit(1 << k)) != 0 for k in range(len(SLOTS))})).filter("slot is not null")
    return found.select("mission_id", "at", "l_subject_id", "r_subject_id", "sample_id", _slot(F.col("slot"), 0).alias("predicate"), _slot(F.col("slot"), 1).alias("band"), "tick", "next_at")


def relation_intervals(samples: DataFrame, tracks: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Relations over time: runs of co-times at which one predicate (and band) holds.

    A run ends at the pair's first co-time at which it doesn't hold, or a second
    after the pair's last co-time.  The run's last sample is the evidence.  One
    window over a pair's co-times keeps the start of each relation's run; the last
    row of a run tells it, so no row a relation and time is shuffled.
    """
    order = Window.partitionBy("mission_id", "l_subject_id", "r_subject_id").orderBy("at", "sample_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = related(samples, tracks, regions)
    rows = rows.withColumns({"was": F.coalesce(F.lag("held").over(order), F.lit(0)), "next": F.coalesce(F.lead("held").over(order), F.lit(0)), "next_at": F.lead("at").over(order)})
    bit = lambda c, k: F.col(c).bitwiseAND(F.lit(1 << k)) != 0
    rows = rows.withColumns({f"start_{k}": F.last(F.when(bit("held", k) & ~bit("was", k), F.col("at")), ignorenulls=True).over(upto) for k in range(len(SLOTS))})
    rows = rows.withColumn("slot", _each({k: bit("held", k) & ~bit("next", k) for k in range(len(SLOTS))})).filter("slot is not null")
    start, end = F.get(F.array(*[F.col(f"start_{k}") for k in range(len(SLOTS))]), F.col("slot")), F.coalesce(F.col("next_at"), F.col("at") + TAIL_SEC)
    return rows.select("mission_id", F.col("l_subject_id").alias("subject_id"), _slot(F.col("slot"), 0).alias("predicate"), F.col("r_subject_id").alias("object_id"), _slot(F.col("slot"), 1).alias("band"), start.alias("start_sec"), end.alias("end_sec"), F.col("sample_id").alias("evidence_id"))


def motion_edges(samples: DataFrame, with_evidence: bool = True) -> DataFrame:
    """Subjects that moved between their first and last sample, against the first other one seen meanwhile.

    A mission's first other subject is the answer if its own first or last sample
    lies in the time; samples are only looked at for the subjects this leaves open.  The evidence is
    the subject's last sample, null unless asked for.
    """
    axes, keys = ("cx", "cy", "cz"), ["mission_id", "subject_id", "start_sec", "end_sec", "evidence_id", "moved_m"]
    # Dealt once by mission, for the grouping and the window; one coordinate at a time, as a grouping of structs would be sorted.
    dealt = samples.filter("mission_id is not null and subject_id is not null").select("mission_id", "subject_id", "sample_id", "t_sec", *axes).repartition("mission_id")
    ends = dealt.groupBy("mission_id", "subject_id").agg(
        F.min("t_sec").alias("start_sec"), F.max("t_sec").alias("last_sec"), *[f(c, "t_sec").alias(f"{p}{c}") for p, f in (("a_", F.min_by), ("z_", F.max_by)) for c in axes], (F.max_by("sample_id", "t_sec") if with_evidence else F.lit(None).cast(samples.schema["sample_id"].dataType)).alias("evidence_id"), F.count("*").alias("n")
    )
    moved_m = distance_3d(tuple(F.col(f"a_{c}") for c in axes), tuple(F.col(f"z_{c}") for c in axes))
    ends = ends.select("mission_id", "subject_id", "start_sec", "last_sec", (F.col("last_sec") + TAIL_SEC).alias("end_sec"), "evidence_id", F.when(F.col("n") >= 2, moved_m).alias("moved_m"))
    mission = Window.partitionBy("mission_id").orderBy("subject_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("subject_id", "start_sec", "last_sec")
    rows = ends.withColumn("first", F.first(row).over(mission)).withColumn("second", F.nth_value(row, 2).over(mission)).filter(F.col("moved_m") > MOVED_M)
    near = F.when(F.col("first.subject_id") == F.col("subject_id"), F.col("second")).otherwise(F.col("first"))
    meets = functools.reduce(lambda x, y: x | y, [F.coalesce((F.col("start_sec") <= near[t]) & (near[t] < F.col("end_sec")), F.lit(False)) for t in ("start_sec", "last_sec")])
    # Written first: it is read for the subjects that are answered and for those left open.
    rows = materialise(rows.select(*keys, F.when(meets, near["subject_id"]).alias("near_id"), F.col("second").isNotNull().alias("has_other")), "motion-ends")
    other = samples.select(F.col("mission_id").alias("o_m"), F.col("subject_id").alias("object_id"), F.col("t_sec").alias("o_t"))
    met = rows.filter("near_id is null and has_other").join(other, (F.col("mission_id") == F.col("o_m")) & (F.col("subject_id") != F.col("object_id")) & (F.col("start_sec") <= F.col("o_t")) & (F.col("o_t") < F.col("end_sec")))
    found = met.groupBy(*keys).agg(F.min("object_id").alias("object_id"))
    return found.unionByName(rows.filter("near_id is not null").select(*keys, F.col("near_id").alias("object_id")))


def series_steps(samples: DataFrame, most_m_s: float = 30.0) -> DataFrame:
    """(mission_id, subject_id, bad_steps, metric) of each series: its steps that are too fast or without time, and whether all of it is metric."""
    order = Window.partitionBy("mission_id", "subject_id").orderBy("t_sec", "sample_id")
    before = lambda c: F.lag(c).over(order)
    step = distance_3d(tuple(F.col(c) for c in ("cx", "cy", "cz")), tuple(before(c) for c in ("cx", "cy", "cz")))
    dt = F.col("t_sec") - before("t_sec")
    bad = F.when(dt.isNotNull(), (dt <= 0) | (step > most_m_s * dt)).otherwise(F.lit(False))
    rows = samples.withColumn("bad", bad)
    return rows.groupBy("mission_id", "subject_id").agg(F.count_if("bad").alias("bad_steps"), F.bool_and(F.col("metric_scale") == "metric").alias("metric"))


def infeasible(samples: DataFrame, most_m_s: float = 30.0) -> DataFrame:
    """Metric series with a step that is too fast, or without time between samples."""
    return series_steps(samples, most_m_s).filter("metric and bad_steps > 0").select("mission_id", "subject_id", "bad_steps")


def dynamic(tracks: DataFrame, least_speed: float) -> DataFrame:
    """Greatest speed of each track's 2D centre, and whether it is dynamic."""
    order = Window.partitionBy("mission_id", "track_id").orderBy("t_sec")
    x, y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    dt = F.col("t_sec") - F.lag("t_sec").over(order)
    speed = F.sqrt((x - F.lag(x).over(order)) ** 2 + (y - F.lag(y).over(order)) ** 2) / dt
    return tracks.withColumn("speed", F.when(dt > 0, speed)).groupBy("mission_id", "track_id").agg(F.coalesce(F.max("speed"), F.lit(0.0)).alias("speed")).withColumn("dynamic", F.col("speed") > least_speed)


def count_changes(tracks: DataFrame) -> DataFrame:
    """Times at which the active ids of a label differ from the time before.

    Every label is looked at in every time of its mission; a label that becomes
    empty gives no row.
    """
    active = tracks.filter(F.col("state").isin(*ACTIVE)).withColumn("at", F.bround("t_sec", 6))
    sets = active.groupBy("mission_id", "label", "at").agg(F.array_sort(F.collect_set("track_id")).alias("ids"))
    times = active.select("mission_id", "at").distinct()
    grid = active.select("mission_id", "label").distinct().join(times, "mission_id")
    dense = grid.join(sets, ["mission_id", "label", "at"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    before = F.coalesce(F.lag("ids").over(Window.partitionBy("mission_id", "label").orderBy("at")), F.array().cast("array<string>"))
    return dense.withColumn("before", before).filter((F.col("ids") != F.col("before")) & (F.size("ids") > 0)).select("mission_id", "label", "at", "ids", F.size("ids").alias("n"))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], holds: Column, time: str = "t_sec") -> DataFrame:
    """Runs of successive rows for which a condition holds: (keys, start_sec, end_sec, n).

    A run ends at the next row for which it doesn't hold, or at its own last row.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("holds", holds).withColumn("next_t", F.lead(time).over(window))
    starts = F.when(F.col("holds") & ~F.coalesce(F.lag("holds").over(window), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = rows.filter("holds").groupBy(*keys, "run").agg(F.min(time).alias("start_sec"), F.max(F.struct(F.col(time).alias("t"), "next_t")).alias("last"), F.count("*").alias("n"))
    return found.select(*keys, "start_sec", F.coalesce("last.next_t", "last.t").alias("end_sec"), "n")


def quality_gaps(signals: DataFrame) -> DataFrame:
    """Spans of bad frames up to the next good one."""
    return runs(signals, ["mission_id"], ["t_sec", "frame_id"], ~F.col("good"))


def check_monotonic(tracks: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Rows of a log whose time is before that of the row above them."""
    before = F.lag("t_sec").over(Window.partitionBy(*keys).orderBy(line))
    return tracks.withColumn("before", before).filter(F.col("t_sec") < F.col("before")).select(*keys, line, "t_sec", "before")


#: Order of a replay: event time, kind, sector, sensor; the id parts what is alike in all.
REPLAY_ORDER = ("event_time", "event_kind", "sector_id", "sensor_type", "event_id")


def replay_stamp(events: DataFrame, keys: Sequence[str], start: Column, delays: dict[str, float], spacing_sec: float = 0.25) -> DataFrame:
    """Total order of each run and the time at which a replay hands on its events.

    The later of (start + spacing * place) and the event's time, plus the delay of
    its kind and the delay of its sensor (0 if none is named); times in seconds.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*REPLAY_ORDER)) - 1
    named = F.create_map(*[F.lit(x) for pair in delays.items() for x in pair]) if delays else None
    delay = lambda c: F.lit(0.0) if named is None else F.coalesce(F.try_element_at(named, F.col(c)), F.lit(0.0))
    ingest = F.greatest(start + spacing_sec * place, F.col("event_time")) + delay("event_kind") + delay("sensor_type")
    return events.withColumn("place", place).withColumn("ingest_time", ingest).withColumn("freshness_sec", F.col("ingest_time") - F.col("event_time"))
