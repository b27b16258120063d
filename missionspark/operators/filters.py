"""Filters and projections over frames, points and graph rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import degrees_box, flat_metres

FACTS = "road_condition string, road_surface string, scene_summary string, vehicle_groups array<struct<count:bigint,type:string>>"


def with_facts(frames: DataFrame) -> DataFrame:
    """Adds ``fact``, the facts document as a struct, and ``vehicles``, their sum."""
    return frames.withColumn("fact", F.from_json("facts", FACTS)).withColumn(
        "vehicles", F.aggregate(F.coalesce(F.col("fact.vehicle_groups"), F.array()), F.lit(0).cast("bigint"), lambda s, g: s + F.coalesce(g["count"], F.lit(0)))
    )


def scene_filter(
    frames: DataFrame, *, road_condition: str | None = None, bbox: tuple[float, float, float, float] | None = None,
    time_range: tuple[float, float] | None = None, vehicles_min: int | None = None, vehicles_max: int | None = None,
) -> DataFrame:
    """Frames with facts that meet all given predicates; ranges are inclusive."""
    rows = frames.filter(F.col("facts").isNotNull())
    if bbox:
        rows = rows.filter(F.col("lat").between(bbox[0], bbox[1]) & F.col("lon").between(bbox[2], bbox[3]))
    if time_range:
        rows = rows.filter(F.col("t_sec").between(*time_range))
    rows = with_facts(rows)
    if road_condition is not None:
        rows = rows.filter(F.col("fact.road_condition") == road_condition)
    if vehicles_min is not None:
        rows = rows.filter(F.col("vehicles") >= vehicles_min)
    if vehicles_max is not None:
        rows = rows.filter(F.col("vehicles") <= vehicles_max)
    return rows


def geo_box(df: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Rows in the box around a circle: what can be pushed to the scan."""
    low, high, west, east = degrees_box(lat, lon, radius_m)
    return df.filter(F.col("lat").between(low, high) & F.col("lon").between(west, east))


def within_metres(df: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Rows in the circle, with ``distance_m``; the box comes first."""
    return geo_box(df, lat, lon, radius_m).withColumn("distance_m", flat_metres(F.col("lat"), F.col("lon"), lat, lon)).filter(F.col("distance_m") <= radius_m)


def within_enu(df: DataFrame, x: float, y: float, z: float, radius_m: float) -> DataFrame:
    """Rows whose local coordinates lie in a ball; rows without them are dropped."""
    d = F.sqrt((F.col("tx") - x) ** 2 + (F.col("ty") - y) ** 2 + (F.col("tz") - z) ** 2)
    return df.withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)


def payload_filter(points: DataFrame, *, type: str | None = None, missions: Sequence | None = None, robots: Sequence[str] | None = None) -> DataFrame:
    """Set filters on a point's payload."""
    if type is not None:
        points = points.filter(F.col("type") == type)
    if missions is not None:
        points = points.filter(F.col("mission_id").isin(list(missions)))
    if robots is not None:
        points = points.filter(F.col("robot_id").isin(list(robots)))
    return points


def edges_at(edges: DataFrame, t: float) -> DataFrame:
    """The graph at a time: half-open intervals that hold it."""
    return edges.filter((F.col("start_sec") <= t) & (F.lit(t) < F.col("end_sec")))


def publishable(df: DataFrame) -> DataFrame:
    """Accepted rows with evidence."""
    return df.filter((F.col("status") == "accepted") & (F.col("n_evidence") > 0))


def check_rows(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row (keys, code) for each rule that a row breaks.

    A rule is a condition that must not be false; null passes.
    """
    codes = F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(code)) for code, rule in rules.items()])
    return df.select(*keys, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def geometry_rules(most_m: float = 10.0) -> dict[str, Column]:
    """Contract of a 3D sample."""
    return {
        "metric_without_calibration": (F.col("metric_scale") != "metric") | F.col("calibration_id").isNotNull(),
        "extent_not_positive": (F.col("ex") > 0) & (F.col("ey") > 0) & (F.col("ez") > 0),
        "depth_out_of_range": F.col("depth_m").between(0.0, most_m),
    }


def edge_rules() -> dict[str, Column]:
    """Contract of an edge."""
    return {"interval_order": F.col("end_sec") > F.col("start_sec"), "accepted_without_evidence": (F.col("status") != "accepted") | (F.col("n_evidence") > 0)}


def track_rules() -> dict[str, Column]:
    """Contract of a track observation: its box lies in the unit square."""
    return {
        "box_outside": (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= 1) & (F.col("y") + F.col("h") <= 1),
        "confidence_outside": F.col("confidence").between(0.0, 1.0),
    }


def sample_rules() -> dict[str, Column]:
    """Contract of a stored 3D sample's shape: extents, quaternion, covariance, vector."""
    norm = F.sqrt(F.aggregate("quaternion", F.lit(0.0), lambda s, x: s + x * x))
    return {
        "extent_not_positive": (F.col("ex") > 0) & (F.col("ey") > 0) & (F.col("ez") > 0), "quaternion_not_unit": (F.size("quaternion") == 4) & (F.abs(norm - 1.0) <= 1e-3),
        "covariance_negative": F.forall("covariance_diag", lambda x: x >= 0), "vector_length": F.size("vector") == F.col("dim"),
    }


def mask_rules() -> dict[str, Column]:
    """Contract of a mask: one bit a pixel."""
    return {"bit_count": (F.length("bits") == F.col("width") * F.col("height")) & F.col("bits").rlike("^[01]*$")}


def delta_rules(predicates: Sequence[str]) -> dict[str, Column]:
    """Contract of a graph delta: a node or an edge, and accepted edges of a predicate that geometry can decide."""
    return {
        "node_or_edge": F.col("node_id").isNull() != F.col("edge_id").isNull(),
        "open_predicate_accepted": F.col("edge_id").isNull() | (F.col("status") != "accepted") | F.coalesce(F.col("predicate").isin(*predicates), F.lit(False)),
        "band_missing": F.coalesce(F.col("predicate") != "distance_band", F.lit(True)) | F.col("band_max").isNotNull(),
    }


def event_rules() -> dict[str, Column]:
    """Contract of an event."""
    return {"interval_order": F.col("end_sec") > F.col("start_sec"), "accepted_without_evidence": (F.col("status") != "accepted") | (F.col("n_evidence") > 0)}


def answer_rules() -> dict[str, Column]:
    """Contract of an answer: accepted ones cite events and are never causal."""
    return {"accepted_without_evidence": (F.col("status") != "accepted") | (F.col("n_evidence") > 0), "causal_accepted": ~((F.col("status") == "accepted") & F.col("program").rlike(r"^caus(ed|al)\("))}


def pending(frames: DataFrame, cursor: tuple | None = None) -> DataFrame:
    """Frames still to caption, behind a cursor of (created_at, frame_id)."""
    rows = frames.filter(F.col("caption").isNull() & F.col("caption_skip_reason").isNull())
    if cursor is not None:
        rows = rows.filter((F.col("created_at") > F.lit(cursor[0])) | ((F.col("created_at") == F.lit(cursor[0])) & (F.col("frame_id") > cursor[1])))
    return rows


def merge_facts(a: Column, b: Column) -> Column:
    """Two maps of facts; the later one wins key by key."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def to_enu(frames: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Adds east and north in metres from the mission's origin.

    A mission without an origin takes its first fix.
    """
    first = frames.filter("lat is not null and lon is not null").groupBy("mission_id").agg(F.min_by(F.struct("lat", "lon"), F.struct("t_sec", "frame_id")).alias("fix"))
    if origins is not None:
        named = origins.select(F.col("mission_id").alias("origin_mission"), F.struct("lat", "lon").alias("origin"))
        first = first.join(named, F.col("mission_id") == F.col("origin_mission"), "left").withColumn("fix", F.coalesce("origin", "fix")).drop("origin_mission", "origin")
    met = frames.join(first.withColumnRenamed("mission_id", "fix_mission"), F.col("mission_id") == F.col("fix_mission"), "left").drop("fix_mission")
    east = (F.col("lon") - F.col("fix.lon")) * 111_320.0 * F.cos(F.radians("fix.lat"))
    return met.withColumn("east_m", east).withColumn("north_m", (F.col("lat") - F.col("fix.lat")) * 111_320.0).drop("fix")


def normalise_detections(df: DataFrame, prompts: DataFrame) -> DataFrame:
    """Pixel boxes (x1, y1, x2, y2) to unit boxes, clamped confidence, prompt by label.

    Labels without a prompt are dropped; prompts are a small table.
    """
    unit = lambda c, size: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / F.col(size)))
    named = prompts.select(F.lower(F.trim("label")).alias("prompt_label"), "prompt_id")
    return (
        df.join(named, F.lower(F.trim("label")) == F.col("prompt_label"))
        .select(
            "frame_id", "prompt_id", unit("x1", "width").alias("x"), unit("y1", "height").alias("y"), (unit("x2", "width") - unit("x1", "width")).alias("w"),
            (unit("y2", "height") - unit("y1", "height")).alias("h"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("confidence"),
        )
        .filter("w > 0 and h > 0")
    )


def signal_drift(thumbs: DataFrame) -> DataFrame:
    """Drift of each thumbnail from its mission's first readable one.

    The larger of the cosine distance and the mean absolute difference.
    """
    from ..functions.exprs import cosine

    first = thumbs.filter("pixels is not null").groupBy(F.col("mission_id").alias("first_mission")).agg(F.min_by("pixels", F.struct("t_sec", "frame_id")).alias("first_pixels"))
    met = thumbs.join(first, F.col("mission_id") == F.col("first_mission"), "left")
    mean = F.aggregate(F.zip_with("pixels", "first_pixels", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size("pixels")
    return met.withColumn("drift", F.greatest(F.lit(1.0) - cosine(F.col("pixels"), F.col("first_pixels")), mean)).drop("first_mission", "first_pixels")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in this order, aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*")


def sample_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], every: int, most: int) -> DataFrame:
    """Every n-th row of each key, at most ``most`` of them."""
    rows = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return rows.filter((F.col("place") % every == 0) & (F.floor(F.col("place") / every) < most))


def clip_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int) -> DataFrame:
    """Fixed windows of rows: (keys, clip, n, carrier): the middle row carries the clip."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = df.withColumn("place", place).withColumn("clip", F.floor(F.col("place") / length))
    size = F.count("*").over(Window.partitionBy(*keys, "clip"))
    middle = F.col("clip") * length + F.floor(F.col("n") / 2)
    return rows.withColumn("n", size).filter(F.col("place") == middle)
