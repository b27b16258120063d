"""Point clouds, cameras and embedding clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise, small

# Fixed values of the box fit and of the camera model.
GATE, LEAST_POINTS, YAWS, UNDISTORT_STEPS = 8.0, 12, 360, 8
LEAST_EXTENT_M, LEAST_DEPTH = 1e-3, 1e-6


def robust_points(points: DataFrame) -> DataFrame:
    """Points within ``GATE`` median absolute deviations of their cloud's median on every axis.

    A cloud of (track_id, t_sec) that would keep fewer than ``LEAST_POINTS`` keeps
    all of them; one that has fewer is left out.
    """
    keys = ["track_id", "t_sec"]
    k = [F.col(c).alias(f"k_{c}") for c in keys]
    same = (F.col("track_id") == F.col("k_track_id")) & (F.col("t_sec") == F.col("k_t_sec"))
    middle = points.groupBy(*k).agg(*[F.median(c).alias(f"m_{c}") for c in "xyz"])
    off = points.join(middle, same).drop("k_track_id", "k_t_sec")
    spread = off.groupBy(*k).agg(*[F.median(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"d_{c}") for c in "xyz"])
    met = off.join(spread, same).drop("k_track_id", "k_t_sec")
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & (F.abs(F.col(c) - F.col(f"m_{c}")) <= GATE * (F.col(f"d_{c}") + 1e-9))
    met = met.withColumn("inside", inside)
    sizes = met.groupBy(*k).agg(F.count("*").alias("n"), F.count_if("inside").alias("n_inside")).filter(F.col("n") >= LEAST_POINTS)
    kept = met.join(sizes, same).filter(F.col("inside") | (F.col("n_inside") < LEAST_POINTS))
    return kept.select("track_id", "t_sec", "x", "y", "z")


def spread(kept: DataFrame) -> DataFrame:
    """(s_track_id, s_t_sec, var_x, var_y, var_z, residual) of each cloud.

    The variances are those of the centre, the points' variance over their number;
    the residual is the median absolute deviation of the distance to the median point.
    """
    keys = [F.col("track_id").alias("s_track_id"), F.col("t_sec").alias("s_t_sec")]
    same = (F.col("track_id") == F.col("s_track_id")) & (F.col("t_sec") == F.col("s_t_sec"))
    middle = kept.groupBy(*keys).agg(*[F.median(c).alias(f"m_{c}") for c in "xyz"], *[(F.var_pop(c) / F.count("*")).alias(f"var_{c}") for c in "xyz"])
    middle = materialise(middle, "cloud-middle")
    far = F.sqrt(sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in "xyz"))
    off = kept.join(middle, same).select("track_id", "t_sec", far.alias("far"))
    usual = materialise(off.groupBy(*keys).agg(F.median("far").alias("usual")), "cloud-usual")
    residual = off.join(usual, same).groupBy(*keys).agg(F.median(F.abs(F.col("far") - F.col("usual"))).alias("residual"))
    return middle.join(residual, ["s_track_id", "s_t_sec"]).select("s_track_id", "s_t_sec", "var_x", "var_y", "var_z", "residual")


def turned_extremes(kept: DataFrame) -> DataFrame:
    """(track_id, t_sec, lows, highs, n): least and greatest u of every yaw, then v of every yaw, then z.

    The points of a cloud come sorted and in batches; a task holds a batch and the
    extremes of the cloud that it is at.  The yaws' cosines and sines are Spark's own.
    """
    yaw = F.radians(F.col("id") / 2)
    table = kept.sparkSession.range(YAWS).select("id", F.cos(yaw).alias("cos"), F.sin(yaw).alias("sin")).orderBy("id").collect()
    cos, sin = np.array([r["cos"] for r in table]), np.array([r["sin"] for r in table])

    def pieces(x, y, z, starts, least, most):
        low, high = np.empty((len(starts), 2 * YAWS + 1)), np.empty((len(starts), 2 * YAWS + 1))
        for k in range(0, YAWS, 24):
            c, s = cos[None, k : k + 24], sin[None, k : k + 24]
            for at, turned in ((k, x * c + y * s), (YAWS + k, y * c - x * s)):
                low[:, at : at + c.shape[1]], high[:, at : at + c.shape[1]] = least.reduceat(turned, starts, axis=0), most.reduceat(turned, starts, axis=0)
        low[:, -1:], high[:, -1:] = least.reduceat(z, starts, axis=0), most.reduceat(z, starts, axis=0)
        return low, high

    def told(names, found):
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * (2 * YAWS + 1)), pa.array(np.concatenate([f[k] for f in found]))) for k in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], names[0]), pa.array([f[1] for f in found], names[1]), *lists, pa.array([f[4] for f in found], pa.int64())], ["track_id", "t_sec", "lows", "highs", "n"])

    def clouds(it):
        at, names = None, None
        for b in it:
            names = [b.schema.field(k).type for k in range(2)]
            track, t = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            x, y, z = (b.column(k).to_numpy(zero_copy_only=False)[:, None] for k in range(2, 5))
            if not len(t):
                continue
            most = np.fmax if any(b.column(k).null_count for k in range(2, 5)) else np.maximum  # Spark's greatest is NaN, a null is none
            differ = lambda v: (v[1:] != v[:-1]) & ((v[1:] == v[1:]) | (v[:-1] == v[:-1]))  # noqa: E731, PLR0124
            starts = np.flatnonzero(np.r_[True, differ(track) | differ(t)])
            low, high = pieces(x, y, z, starts, np.fmin, most)
            sizes, found = np.diff(np.r_[starts, len(t)]), []
            for k, start in enumerate(starts.tolist()):
                key = (track[start], t[start])
                if at is not None and (key == at[:2] or key[0] == at[0] and key[1] != key[1] and at[1] != at[1]):
                    at = (*at[:2], np.fmin(at[2], low[k]), most(at[3], high[k]), at[4] + int(sizes[k]))
                else:
                    found += [at] * (at is not None)
                    at = (*key, low[k], high[k], int(sizes[k]))
            if found:
                yield told(names, found)
        if at is not None:
            yield told(names, [at])

    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("track_id", "t_sec"))
    rows = kept.select("track_id", "t_sec", "x", "y", "z").repartition("track_id", "t_sec").sortWithinPartitions("track_id", "t_sec")
    return rows.mapInArrow(clouds, f"{kinds}, lows array<double>, highs array<double>, n long")


def box_fit(points: DataFrame) -> DataFrame:
    """Gravity-aligned box of each cloud: the yaw, in half degrees, with the least ground area.

    (track_id, t_sec, yaw, length, width, height, cx, cy, cz, n) with the spread
    (var_x, var_y, var_z, residual); no side is shorter than ``LEAST_EXTENT_M``.
    Each point meets all yaws inside its task, which gives a row a cloud.
    """
    kept = materialise(robust_points(points), "cloud-points")
    wide = lambda k: F.get("highs", k) - F.get("lows", k)
    areas = F.transform(F.sequence(F.lit(0), F.lit(YAWS - 1)), lambda k: F.struct(F.round(wide(k) * wide(k + YAWS), 9).alias("area"), k.alias("step")))
    best = turned_extremes(kept).withColumn("step", F.array_min(areas).getField("step"))
    ends = [F.get(c, at).alias(f"{n}_{a}") for a, at in (("u", F.col("step")), ("v", F.col("step") + YAWS), ("z", F.lit(2 * YAWS))) for n, c in (("lo", "lows"), ("hi", "highs"))]
    best = best.select("track_id", "t_sec", F.struct("step", *ends, "n").alias("b"))
    a, u, v = F.radians(F.col("b.step") / 2), (F.col("b.lo_u") + F.col("b.hi_u")) / 2, (F.col("b.lo_v") + F.col("b.hi_v")) / 2
    side = lambda c: F.greatest(F.col(f"b.hi_{c}") - F.col(f"b.lo_{c}"), F.lit(LEAST_EXTENT_M))
    best = best.join(spread(kept), (F.col("track_id") == F.col("s_track_id")) & (F.col("t_sec") == F.col("s_t_sec")))
    return best.select(
        "track_id", "t_sec", (F.col("b.step") / 2).alias("yaw"), side("u").alias("length"), side("v").alias("width"), side("z").alias("height"),
        (u * F.cos(a) - v * F.sin(a)).alias("cx"), (u * F.sin(a) + v * F.cos(a)).alias("cy"), ((F.col("b.lo_z") + F.col("b.hi_z")) / 2).alias("cz"), F.col("b.n").alias("n"), "var_x", "var_y", "var_z", "residual",
    )


def undistorted(df: DataFrame) -> DataFrame:
    """Adds ideal image coordinates (x_n, y_n) of pixels (u, v): fixed steps of the radial model."""
    df = df.withColumn("x_d", (F.col("u") - F.col("cu")) / F.col("fu")).withColumn("y_d", (F.col("v") - F.col("cv")) / F.col("fv")).withColumn("x_n", F.col("x_d")).withColumn("y_n", F.col("y_d"))
    for _ in range(UNDISTORT_STEPS):
        r2 = F.col("x_n") * F.col("x_n") + F.col("y_n") * F.col("y_n")
        factor = 1 + F.col("k1") * r2 + F.col("k2") * r2 * r2
        df = df.withColumn("factor", factor).withColumn("x_n", F.col("x_d") / F.col("factor")).withColumn("y_n", F.col("y_d") / F.col("factor"))
    return df.drop("factor", "x_d", "y_d")


def backproject(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """Depth pixels (track_id, t_sec, camera_id, u, v, depth, mask) to points in the mission's frame.

    Only masked pixels with a finite depth above ``LEAST_DEPTH`` count.  Cameras without a
    calibration give depths in units of their cloud's median, if it has enough
    pixels.  Cameras have their place (px, py, pz) and may have ``rotation``, the
    nine numbers, row by row, that turn the mission's frame into theirs.
    ``reprojection_px`` is the way back to the pixel.
    """
    turned = "rotation" in cameras.columns
    # By broadcast: a shuffle by camera would bring all pixels of a camera to one task.
    named = small(cameras.select(F.col("camera_id").alias("c_id"), "fu", "fv", "cu", "cv", "k1", "k2", "px", "py", "pz", "calibrated", *["rotation"] * turned))
    rows = pixels.filter(f"mask and depth > {LEAST_DEPTH} and depth < double('inf')").join(named, F.col("camera_id") == F.col("c_id")).drop("c_id")
    # Written first: a join that reuses the grouping's shuffle couldn't split a large cloud.
    scale = materialise(rows.groupBy(F.col("track_id").alias("s_track"), F.col("t_sec").alias("s_t")).agg(F.median("depth").alias("unit"), F.count("*").alias("n")), "cloud-units")
    rows = rows.join(scale, (F.col("track_id") == F.col("s_track")) & (F.col("t_sec") == F.col("s_t")))
    rows = rows.filter(F.col("calibrated") | (F.col("n") >= LEAST_POINTS)).withColumn("depth", F.when(F.col("calibrated"), F.col("depth")).otherwise(F.col("depth") / F.col("unit")))
    rows = undistorted(rows)
    r2 = F.col("x_n") ** 2 + F.col("y_n") ** 2
    back = lambda c, f, m: F.col(c) * (1 + F.col("k1") * r2 + F.col("k2") * r2 * r2) * F.col(f) + F.col(m)
    error = F.sqrt((back("x_n", "fu", "cu") - F.col("u")) ** 2 + (back("y_n", "fv", "cv") - F.col("v")) ** 2)
    seen = (F.col("x_n") * F.col("depth"), F.col("y_n") * F.col("depth"), F.col("depth"))
    place = [sum(s * F.get("rotation", F.lit(3 * i + k)) for i, s in enumerate(seen)) if turned else seen[k] for k in range(3)]
    return rows.select("track_id", "t_sec", *[(p + F.col(f"p{c}")).alias(c) for p, c in zip(place, "xyz")], error.alias("reprojection_px"))


def reprojection_error(points: DataFrame) -> DataFrame:
    """(track_id, t_sec, error_px, n): mean way back to the pixel of each cloud of :func:`backproject`."""
    return points.groupBy("track_id", "t_sec").agg(F.avg("reprojection_px").alias("error_px"), F.count("*").alias("n"))


def centroid_distance(frames: DataFrame, most: int = 20, seed: int = 1) -> DataFrame:
    """Cluster of each vector and its distance to the nearest centroid, k = min(most, n)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = frames.select("id", array_to_vector(F.col("vector")).alias("features"))
    n = rows.limit(most).count()
    model = KMeans(k=max(2, n), seed=seed, maxIter=20).fit(rows)
    centres = [list(map(float, c)) for c in model.clusterCenters()]  # at most ``most`` vectors
    own = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("prediction") + 1)
    square = F.aggregate(F.zip_with("vector", own, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    placed = model.transform(frames.withColumn("features", array_to_vector(F.col("vector"))))
    return placed.select("id", F.col("prediction").alias("cluster"), F.sqrt(square).alias("distance"))

