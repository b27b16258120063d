"""Column expressions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M_PER_DEGREE = 111_320.0


def half_even(x: Column, digits: int) -> Column:
    """Round half to even, as times are rounded before they are joined."""
    return F.bround(x, digits)


def flat_metres(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> Column:
    """Distance on a plane that touches the earth at (lat0, lon0); the short way over the date line."""
    lat0, lon0 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat0, lon0))
    north = (lat - lat0) * EARTH_M_PER_DEGREE
    apart = lon - lon0
    east = F.when(F.abs(apart) > 180, apart - F.signum(apart) * 360).otherwise(apart) * EARTH_M_PER_DEGREE * F.cos(F.radians(lat0))
    return F.sqrt(north * north + east * east)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def span_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length that two spans share, at least 0."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def iou_2d(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of boxes (x, y, w, h)."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    inter = span_overlap(ax, ax + aw, bx, bx + bw) * span_overlap(ay, ay + ah, by, by + bh)
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def iou_3d(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of boxes (cx, cy, cz, ex, ey, ez), extents whole."""
    inter, va, vb = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for k in range(3):
        (c1, e1), (c2, e2) = (a[k], a[k + 3]), (b[k], b[k + 3])
        inter = inter * span_overlap(c1 - e1 / 2, c1 + e1 / 2, c2 - e2 / 2, c2 + e2 / 2)
        va, vb = va * e1, vb * e2
    union = va + vb - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def distance_3d(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def temporal_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    union = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(union > 0, span_overlap(s1, e1, s2, e2) / union).otherwise(F.lit(0.0))


def degrees_box(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """(lat low, lat high, lon low, lon high) around a point."""
    dlat = radius_m / EARTH_M_PER_DEGREE
    dlon = radius_m / (EARTH_M_PER_DEGREE * max(0.01, math.cos(math.radians(lat))))
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon
