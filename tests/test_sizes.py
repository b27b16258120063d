"""Forms that keep work in proportion to the rows: what a plan may not hold, and results on crowded keys."""

from __future__ import annotations

import __spark_entry__ as entry
from missionspark.operators import joins as J
from missionspark.operators import metrics as M
from missionspark.operators import ranking as K
from missionspark.streaming import selection as S


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_in_time_never_pairs_a_bucket(spark):
    left = spark.createDataFrame([(0, i, i * 0.01) for i in range(300)] + [(1, 900, 50.0), (None, 901, 1.0)], "m long, a long, t_sec double")
    right = spark.createDataFrame([(0, j, (j % 50) * 0.06) for j in range(200)] + [(1, 500, 50.75), (1, 501, 49.25), (None, 502, 1.0)], "m long, b long, t_sec double")
    found = J.nearest_in_time(left, right, ["m"], "a", "b", 0.75)
    assert "Join" not in plan(found)
    want = {}
    for m, a, t in left.collect():
        near = [(abs(t - u), u, b) for n, b, u in right.collect() if n == m and m is not None and abs(t - u) <= 0.75]
        if near:
            want[a] = (min(near)[0], min(near)[2])
    assert {r.a: (r.off, r.nearest_id) for r in found.collect()} == want and 900 in want and 901 not in want


def test_mask_quality_makes_no_row_for_a_pixel(spark):
    schema = "mission_id long, mask_id long, width int, height int, bits string"
    truth = spark.createDataFrame([(1, 1, 3, 3, "111111000"), (1, 2, 3, 3, "111111111"), (1, 3, 2, 1, "00"), (2, 1, 4, 2, "1111"), (2, 2, 2, 2, None)], schema)
    pred = spark.createDataFrame([(1, 1, 3, 3, "111111111"), (1, 3, 2, 1, "00"), (2, 1, 2, 2, "1111"), (2, 2, 2, 2, "1111"), (3, 1, 2, 2, "1111")], schema)
    found = M.mask_quality(pred, truth)
    assert "Generate" not in plan(found)
    f = 2 * (5 / 8) * (5 / 6) / (5 / 8 + 5 / 6)
    assert {r.mission_id: (r.j, r.f) for r in found.collect()} == {1: (round(6 / 9 / 3, 6), round(f / 3, 6)), 2: (0.5, 0.5)}


def test_changes_are_the_nearest_of_all_pairs_in_slices(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(k, k % 3, 52.0 + (k % 9) * 0.001, 13.0 + (k % 7) * 0.001, rng.normal(size=8).round(1).tolist()) for k in range(150)]
    rows += [(200, 1, 52.0, 13.0, rows[0][4]), (201, 2, 52.0, 13.0, rows[0][4]), (202, 1, 52.0, 13.0, None)]
    df = spark.createDataFrame(rows, "id long, mission_id long, lat double, lon double, embedding array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for i, m, lat, lon, v in rows[:-1]:
        far = lambda r: float(np.hypot((lat - r[2]) * 111320, (lon - r[3]) * 111320 * np.cos(np.radians(r[2]))))  # noqa: B023, E731
        near = [(round(1 - float(unit(v) @ unit(r[4])), 9), r[0]) for r in rows[:-1] if r[1] != m and far(r) <= 250.0]
        if near and min(near)[0] > 0.1:
            want[i] = min(near)
    monkeypatch.setattr(J, "FRAME_SLICE", 7)
    monkeypatch.setattr(J, "REFERENCE_SLICE", 11)
    found = J.detect_changes(df, 250.0, 0.1)
    assert "r_mission_id" not in plan(found)  # no pair of frames is a row
    got = {r.id: (r.distance, r.reference) for r in found.collect()}
    assert {i: r for i, (_, r) in got.items()} == {i: r for i, (_, r) in want.items()} and len(got) > 50


def test_vector_scan_keeps_bounded_slices(spark, monkeypatch):
    rows = [(k, [float(k % 5 - 2), float(k % 3), 1.0]) for k in range(90)] + [(100, [0.0, 0.0, 0.0]), (101, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = {(r.query_id, r.place): (r.id, r.score) for r in K.vector_topk(df, df.filter("id % 10 = 0"), 4).collect()}
    monkeypatch.setattr(K.C, "POINT_SLICE", 16)
    monkeypatch.setattr(K.C, "QUERY_SLICE", 4)
    found = K.vector_topk(df, df.filter("id % 10 = 0"), 4)
    assert "FlatMapCoGroups" in plan(found)  # queries are dealt, not collected
    assert {(r.query_id, r.place): (r.id, r.score) for r in found.collect()} == want and len(want) == 36
    assert want[0, 1] == (15, 1.0) and all(i not in (100, 101) for i, _ in want.values())


def test_sites_meet_places_not_missions(spark):
    missions = spark.range(40).selectExpr("id AS mission_id", "IF(id < 38, 50.0D, null) AS lat", "IF(id % 2 = 0, 10.0D, 20.0D) AS lon")
    sites = spark.range(30).selectExpr("id + 5 AS site_id", "50.01D AS lat", "10.0D AS lon")
    found = J.assign_sites(missions, sites)
    assert plan(found).count("Aggregate") >= 3  # places of missions, places of sites, the nearest
    rows = {r.mission_id: r for r in found.collect()}
    assert len(rows) == 40 and {rows[k].site for k in range(0, 38, 2)} == {"5"} and rows[0].distance_m > 1000
    assert rows[1].site.startswith("new:") and rows[39].distance_m is None


def test_tracks_of_sorted_missions_are_those_of_groups(spark):
    rows = [(m, f"d{m}-{t}-{k}", t * 0.5, "car", 0.1 * k + 0.02 * t, 0.2, 0.1, 0.1, t == 6, [1.0, float(k), 0.5]) for m in range(5) for t in range(9) for k in range(3) if (m + t + k) % 4]
    df = spark.createDataFrame(rows, "mission_id long, detection_id string, t_sec double, label string, x double, y double, w double, h double, cut boolean, descriptor array<double>")
    frames = spark.createDataFrame([(m, t * 0.5, False) for m in range(6) for t in range(12)], "mission_id long, t_sec double, cut boolean")
    found = S.track(df, frames)
    assert "FlatMapGroups" not in plan(found)  # no mission is one pandas group
    want = [tuple(r) for _, g in S.observed(df, frames).toPandas().groupby("mission_id") for r in S.track_rows({"born": 0, "live": {}}, g["mission_id"].iloc[0], g).itertuples(index=False)]
    key = lambda r: tuple(map(str, (*r[:2], r[3], r[4])))
    got = sorted((tuple(r) for r in found.collect()), key=key)
    assert got and [r[:2] + r[3:] for r in got] == [tuple(r[:2]) + tuple(r[3:]) for r in sorted(want, key=key)]


def test_audit_reads_the_tree_once(spark, sf_dir):
    assert "binaryFile" not in plan(entry.queries()["s3_audit_artifacts"](spark, sf_dir))
