"""Vector search by cells against a scan."""

from __future__ import annotations

import numpy as np
import pytest

from missionspark.operators import cells as C


def scan(points, queries, k):
    ids, x = np.array([i for i, _ in points]), C.unit([v for _, v in points])
    want = {}
    for q, v in queries:
        score = np.round(C.unit([v])[0] @ x.T, 9)
        score[ids == q] = -np.inf
        order = np.lexsort((ids, -score))[:k]
        want[q] = [(int(ids[i]), float(score[i])) for i in order if np.isfinite(score[i])]
    return want


def found(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def clustered(n, dims=16, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    return [(k, (middle[k % groups] * rng.choice([0.5, 3.0]) + 0.25 * rng.normal(size=dims)).tolist()) for k in range(n)]


KIND = "id long, embedding array<double>"


def test_exact_way_is_a_scan(spark):
    points = clustered(1_500) + [(5_000 + k, [1.0] + [0.0] * 15) for k in range(30)] + [(6_000, [0.0] * 16)]
    queries = points[::7] + [(9_000, [1.0] * 16), (9_001, [-1.0] + [0.0] * 15)]
    df, q = spark.createDataFrame(points + [(7_000, None)], KIND), spark.createDataFrame(queries + [(9_002, None)], KIND)
    for cells in (1, 40):
        index = C.build(df, cells=cells)
        got, want = found(C.search(index, q, 4, probes=2)), scan(points, queries, 4)
        assert got.keys() == want.keys()
        for key, rows in want.items():
            assert [i for i, _ in got[key]] == [i for i, _ in rows] and [s for _, s in got[key]] == pytest.approx([s for _, s in rows], abs=1e-8)
    assert C.build(df.filter("id = 7000")) is None and C.search(None, q, 3).count() == 0
    assert found(C.search(C.build(df.filter("id in (1, 2)")), q.filter("id = 7"), 5)).keys() == {7}


def test_slices_of_a_hot_cell(spark, monkeypatch):
    points = clustered(400, groups=2)
    df = spark.createDataFrame(points, KIND)
    want = found(C.search(C.build(df, cells=2), df, 3))
    monkeypatch.setattr(C, "POINT_SLICE", 50)
    monkeypatch.setattr(C, "QUERY_SLICE", 30)
    assert found(C.search(C.build(df, cells=2), df, 3)) == want == scan_ids(want, points)


def scan_ids(like, points):
    want = scan(points, points, 3)
    return {q: [(i, s) for (i, _), (_, s) in zip(want[q], rows)] for q, rows in like.items()}


def test_approximate_way_looks_into_few_cells(spark):
    points = clustered(2_000)
    df = spark.createDataFrame(points, KIND)
    index = C.build(df, cells=40)
    got, want = found(C.search(index, df, 5, probes=4, exact=False)), scan(points, points, 5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in rows}) for q, rows in want.items())
    assert hits >= 0.95 * 5 * len(points)
    first = C.routed(index, df.selectExpr("id AS query_id", "embedding AS v"), 5, 4, False).count()
    assert first <= 6 * len(points)  # of forty cells


def test_a_query_goes_once_to_a_block_of_cells(spark):
    rng = np.random.default_rng(3)
    points = [(k, rng.normal(size=16).tolist()) for k in range(600)]  # no structure: most cells may hold a near point
    df = spark.createDataFrame(points, KIND)
    index = C.build(df, cells=60)
    asked = df.selectExpr("id AS query_id", "embedding AS v", "0.0D AS least")
    assert C.routed(index, asked, 5, 2, True).groupBy("query_id").count().filter("count > 1").count() == 0
    got = found(C.search(index, df, 5, probes=2))
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in rows] for q, rows in scan(points, points, 5).items()}
