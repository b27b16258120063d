"""Top-k searches and ordered listings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C
from .aggregates import order_statistics
from .filters import geo_box, scene_filter, within_enu, within_metres


def vector_topk(points: DataFrame, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """The k nearest points of each query by cosine: (query_id, id, score, place).

    Points and queries are dealt to slices of bounded size, and each pair of
    slices keeps the k best of its queries; nothing passes through the driver.
    A point is not its own neighbour; equal scores go by id; vectors that are
    null or have no direction are left out.
    """
    p = points.filter(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("id"), C.narrow(points, vector).alias("v"))
    q = queries.filter(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("query_id"), C.narrow(queries, vector).alias("v"))
    n, m = p.count(), q.count()
    p_slices = max(-(-n // C.POINT_SLICE), min(points.sparkSession.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    q_slices = max(1, -(-m // C.QUERY_SLICE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = q.select("query_id", F.col("v").alias("v"), mine("query_id", q_slices).alias("q"), every(p_slices).alias("p"))
    right = p.select(F.col("id").alias("id"), F.col("v").alias("v"), mine("id", p_slices).alias("p"), every(q_slices).alias("q"))

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        asked, held = directed(asked), directed(held)
        return C.best_of(asked["query_id"].to_numpy(np.int64), asked["v"], np.full(len(asked), -2.0), held["id"].to_numpy(np.int64), held["v"], k)

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(best, C.FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def directed(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows whose vector ``v`` has a finite length above 0."""
    length = np.array([np.linalg.norm(np.asarray(x, np.float64)) for x in rows["v"]])
    return rows[np.isfinite(length) & (length > 0)]


def rerank(clip: DataFrame, dino: DataFrame, active: bool = True) -> DataFrame:
    """Blends two result lists (query_id, id, score): 0.7 and 0.3 where both have the point.

    While vectors are being rebuilt (``active`` false) the first list stays.
    """
    if not active:
        return clip.withColumn("blend", F.col("score"))
    other = dino.select(F.col("query_id").alias("q"), F.col("id").alias("i"), F.col("score").alias("other"))
    met = clip.join(other, (F.col("query_id") == F.col("q")) & (F.col("id") == F.col("i")), "left").drop("q", "i")
    return met.withColumn("blend", F.when(F.col("other").isNull(), F.col("score")).otherwise(0.7 * F.col("score") + 0.3 * F.col("other"))).drop("other")


def scene_query(frames: DataFrame, scores: DataFrame, k: int, **options) -> DataFrame:
    """Filtered frames, newest first, over-fetched and re-ranked by score.

    Frames with a score come first; others follow with 1 - i / k by their place.
    """
    take = min(500, 5 * k)
    newest = scene_filter(frames, **options).orderBy(F.desc("created_at"), "frame_id").limit(take)
    placed = newest.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), "frame_id")) - 1)  # at most 500 rows
    met = placed.join(scores.withColumnRenamed("frame_id", "scored"), F.col("frame_id") == F.col("scored"), "left").drop("scored")
    ranked = met.orderBy(F.col("score").isNull(), F.desc("score"), "i").limit(k)
    return ranked.withColumn("score", F.coalesce("score", F.lit(1.0) - F.col("i") / F.lit(float(k))))


def pose_query(points: DataFrame, k: int, *, gps: tuple[float, float] | None = None, enu: tuple[float, float, float] | None = None, radius_m: float = 50.0) -> DataFrame:
    """The k nearest points within a radius, by place on earth or local coordinates."""
    near = within_metres(points, *gps, radius_m) if gps else within_enu(points, *enu, radius_m)
    return near.orderBy("distance_m", "id").limit(k)


def last_visits(rows: DataFrame, lat: float, lon: float, radius_m: float, k: int = 3) -> DataFrame:
    """The newest rows in the box around a place."""
    return geo_box(rows, lat, lon, radius_m).orderBy(F.desc("created_at"), "frame_id").limit(k)


def annotation_queue(frames: DataFrame, tag: str, k: int) -> DataFrame:
    """Best scored frames of a tag, nulls last, with the number of all of them."""
    rows = frames.filter(F.col("al_tag") == tag)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc_nulls_last("al_score"), "frame_id").limit(k).crossJoin(F.broadcast(total))  # one row


def recent(df: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """The newest rows."""
    return df.orderBy(F.desc(order), tie).limit(k)


def route_captions(frames: DataFrame, k: int) -> DataFrame:
    """Marks the k frames of each mission that change most for the costly model."""
    place = F.row_number().over(Window.partitionBy("mission_id").orderBy(F.desc("hist_diff"), "frame_id"))
    return frames.withColumn("model", F.when(place <= k, "large").otherwise("small"))


def list_rows(df: DataFrame, mission_id, **equals) -> DataFrame:
    """Rows of a mission in order of start, with optional equality filters."""
    rows = df.filter(F.col("mission_id") == mission_id)
    for column, value in equals.items():
        rows = rows.filter(F.col(column) == value)
    return rows.orderBy("start_sec", df.columns[0])


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The percentile at rank ceil(share * n) of each key."""
    found = order_statistics(df, keys, value, {"rank": F.ceil(F.lit(share) * F.col("n"))})
    return found.select(*keys, F.col("value").alias("percentile"), "n")
