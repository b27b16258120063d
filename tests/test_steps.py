"""How often the shared steps read and shuffle their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from missionspark.operators import cloud as C
from missionspark.operators import graph as V
from missionspark.operators import intervals as W
from missionspark.operators import joins as J
from missionspark.operators import logs as G


def test_nearest_pairs_reads_samples_once(spark, tmp_path):
    samples = [(1, s, t, t * k, 0.0, 0.0) for s, k, times in (("a", 1.0, (0.0, 1.0, 2.0)), ("b", 2.0, (0.5, 1.5)), ("c", 3.0, (9.0,))) for t in times]
    spark.createDataFrame(samples, "mission_id long, subject_id string, t_sec double, cx double, cy double, cz double").write.parquet(f"{tmp_path}/s")
    claims = [(1, 1, "a", "b", 0.0, 3.0), (2, 1, "a", "b", 1.0, 1.2), (3, 1, "a", "c", 0.0, 3.0), (4, 1, "x", "c", 0.0, 3.0), (5, 1, "a", "a", 0.0, 3.0)]
    spark.createDataFrame(claims, "claim_id long, mission_id long, subject_id string, object_id string, start_sec double, end_sec double").write.parquet(f"{tmp_path}/c")
    found = V.nearest_pairs(spark.read.parquet(f"{tmp_path}/c"), spark.read.parquet(f"{tmp_path}/s"))
    rows = sorted((r.pair_id, r.l and r.l.t_sec, r.r and r.r.t_sec, r.has_l, r.has_r, r.moved_m) for r in found.collect())
    # Of equal gaps the earliest; the same subject on both sides meets itself; a claim without samples has no row.
    assert rows == [(1, 0.0, 0.5, True, True, 2.0), (2, None, None, True, False, None), (3, None, None, True, False, 2.0), (5, 0.0, 0.0, True, True, 2.0)]
    assert found._jdf.queryExecution().sparkPlan().toString().count(f"{tmp_path}/s]") == 1


def test_backproject_keeps_pixels_of_a_camera_apart(spark):
    pixels = spark.range(40).selectExpr("id track_id", "0e0 t_sec", "id % 2 camera_id", "10e0 u", "10e0 v", "2e0 depth", "true mask")
    cameras = spark.createDataFrame([(k, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, True) for k in range(2)], "camera_id long, fu double, fv double, cu double, cv double, k1 double, k2 double, px double, py double, pz double, calibrated boolean")
    out = C.backproject(pixels, cameras)
    assert out.count() == 40 and "hashpartitioning(camera_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_relation_intervals_shuffle_no_row_a_relation(spark):
    samples = [(1, s, f"{s}{t}", float(t), x, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, "metric") for s, places in (("a", (0.0, 0.0, 9.0, 0.0)), ("b", (5.0, 5.0, 5.0, 5.0))) for t, x in enumerate(places)]
    kind = "mission_id long, subject_id string, sample_id string, t_sec double, " + ", ".join(f"{p}{a} double" for p in "ce" for a in "xyz") + ", depth_m double, metric_scale string"
    found = W.relation_intervals(spark.createDataFrame(samples, kind))
    rows = sorted((r.start_sec, r.end_sec, r.evidence_id) for r in found.filter("subject_id = 'a' and predicate = 'left_of'").collect())
    assert rows == [(0.0, 2.0, "a1"), (3.0, 4.0, "a3")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "cx#" not in plan.split("Window", 1)[1].split("Exchange", 1)[0]


def test_check_refs_sorts_nothing(spark):
    rows, table = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "ref string"), spark.createDataFrame([("a",), ("a",), (None,)], "known string")
    found = J.check_refs({"k": (rows, "ref", table, "known")})
    assert [tuple(r) for r in found.collect()] == [("k", "b", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_count_claims_read_a_text_once(spark):
    tracks = [(1, "a", "Cars", 0.0, "confirmed"), (1, "b", "CARSS", 0.0, "confirmed"), (1, "b", "CARSS", 1.0, "lost"), (1, "p", "bus", 0.0, "confirmed")]
    tracks = spark.createDataFrame(tracks, "mission_id long, track_id string, label string, t_sec double, state string")
    samples = spark.createDataFrame([(1, "a", 0.5, "a@0"), (1, "p", 0.5, "p@0")], "mission_id long, subject_id string, t_sec double, sample_id string")
    texts = ["two cars", "One-car waits", "zero cars", "1 buses", "1 bus", "cars", "", None, "3 cars"]
    claims = spark.createDataFrame([(k, 1, text, float(k)) for k, text in enumerate(texts)], "claim_id long, mission_id long, text string, start_sec double")
    nodes = spark.createDataFrame([], "mission_id long, node_id string, track_id string")
    events = spark.createDataFrame([], "mission_id long, event_id string, type string, participants array<string>")
    found = V.claim_count_events(claims, tracks, nodes, samples, events)
    assert sorted((r.event_id, r.n, r.ids, r.evidence_id) for r in found.collect()) == [("evt-count-bu-0004000", 1, ["p"], "p@0"), ("evt-count-car-0000000", 2, ["a", "b"], "a@0"), ("evt-count-car-0001000", 1, ["a"], "a@0")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_motion_edges_join_only_what_the_first_other_leaves_open(spark, monkeypatch):
    places = {"a": (0.0, 9.0), "b": (0.0, 1.0, 2.0, 9.0), "c": (4.0, 5.0), "d": (4.5, 5.5), "e": (20.0, 21.0), "f": (21.5, None), "still": (0.0, 1.0)}
    rows = [(1, s, f"{s}{k}", t, float(k) if s != "still" else 0.0, 0.0, 0.0) for s, times in places.items() for k, t in enumerate(times)]
    rows += [(2, "alone", f"{k}", float(k), float(k), 0.0, 0.0) for k in range(2)] + [(None, s, f"{s}{k}", float(k), float(k), 0.0, 0.0) for s in "xy" for k in range(2)]
    samples = spark.createDataFrame(rows, "mission_id long, subject_id string, sample_id string, t_sec double, cx double, cy double, cz double")
    written = []
    real = W.materialise
    monkeypatch.setattr(W, "materialise", lambda df, name: written.append(real(df, name)) or written[-1])
    # "a" and "b" span "c" and "d" without a sample there; "e" meets "f" alone, after its own last sample.
    want = [("a", "b", 10.0, "a1"), ("b", "a", 10.0, "b3"), ("c", "d", 6.0, "c1"), ("d", "c", 6.5, "d1"), ("e", "f", 22.0, "e1")]
    assert sorted((r.subject_id, r.object_id, r.end_sec, r.evidence_id) for r in W.motion_edges(samples).collect()) == want
    assert sorted(r.subject_id for r in written[0].filter("near_id is null and has_other").collect()) == ["c", "d", "e"]
    assert [(r.subject_id, r.evidence_id) for r in W.motion_edges(samples, with_evidence=False).orderBy("subject_id").collect()] == [(w[0], None) for w in want]


def test_repeated_ids_are_dealt_by_their_number(spark, monkeypatch):
    a = spark.range(100).selectExpr("id % 98 x", "if(id = 7, null, id) y")
    b = spark.range(3).selectExpr("id z")
    monkeypatch.setattr(G, "TASK_IDS", 9)
    found = G.repeated_ids([(a, {"x": F.col("x").cast("string"), "y": F.col("y").cast("string")}), (b, {"x": F.col("z").cast("string")})])
    assert sorted(tuple(r) for r in found.collect()) == [("x", "0", 3), ("x", "1", 3), ("x", "2", 2)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # Each table is read once, and nothing is counted before the 203 ids are dealt to 23 tasks.
    assert plan.count("Range (0, 100") == 1 and "Aggregate" not in plan.split("Exchange hashpartitioning(place", 1)[1] and ", 23)" in plan
    assert G.check_unique({"k": (b.union(b), "z")}).count() == 3
