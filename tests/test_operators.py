"""Literal cases of single operators."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from missionspark.functions.exprs import distance_3d, iou_2d, iou_3d, temporal_iou
from missionspark.operators import aggregates as A
from missionspark.operators import filters as P
from missionspark.operators import graph as V
from missionspark.operators import identities as I
from missionspark.operators import intervals as W
from missionspark.operators import joins as J
from missionspark.operators import logs as G
from missionspark.operators import metrics as M


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_expressions(spark):
    one = lambda *x: tuple(F.lit(float(v)) for v in x)
    row = spark.range(1).select(
        iou_2d(one(0, 0, 1, 1), one(0.5, 0, 1, 1)), iou_2d(one(0, 0, 0, 0), one(0, 0, 0, 0)), iou_3d(one(0, 0, 0, 2, 2, 2), one(1, 0, 0, 2, 2, 2)),
        distance_3d(one(0, 0, 0), one(3, 4, 0)), temporal_iou(*one(0, 2, 1, 3)), temporal_iou(*one(0, 1, 1, 2)),
    ).first()
    assert row[0] == pytest.approx(1 / 3) and row[1] == 0 and row[2] == pytest.approx(1 / 3) and row[3] == 5 and row[4] == pytest.approx(1 / 3) and row[5] == 0


GEO = "mission_id long, subject_id string, sample_id string, t_sec double, cx double, cy double, cz double, ex double, ey double, ez double, depth_m double, metric_scale string, calibration_id string"


def sample(subject, t, x, z=0.0, scale="metric", extent=1.0, depth=1.0):
    return (1, subject, f"{subject}@{t}", float(t), float(x), 0.0, float(z), extent, extent, extent, depth, scale, "c")


def test_relation_holds_until_the_first_failing_time(spark):
    g = spark.createDataFrame([sample("a", t, x) for t, x in ((0, 0), (1, 0), (2, 9), (3, 0))] + [sample("b", t, 5) for t in range(4)], GEO)
    found = W.relation_intervals(g).filter("subject_id = 'a' and predicate = 'left_of'")
    assert rows(found.select("start_sec", "end_sec", "evidence_id"), "start_sec") == [(0.0, 2.0, "a@1"), (3.0, 4.0, "a@3")]


def test_supports_needs_metric_samples(spark):
    for scale, n in (("metric", 1), ("relative", 0)):
        g = spark.createDataFrame([sample("table", 0, 0, 0.0, scale), sample("cup", 0, 0, 1.02, scale)], GEO)
        assert W.relations(g).filter("predicate = 'supports'").count() == n


def test_row_order_and_partitions_do_not_matter(spark):
    data = [sample("a", t, t % 3) for t in range(6)] + [sample("b", t, 1) for t in range(6)]
    first = sorted(map(str, W.relation_intervals(spark.createDataFrame(data, GEO)).collect()))
    assert first == sorted(map(str, W.relation_intervals(spark.createDataFrame(data[::-1], GEO).repartition(7)).collect()))


def test_infeasible_needs_all_metric(spark):
    g = spark.createDataFrame([sample("a", 0, 0), sample("a", 1, 50), sample("b", 0, 0, scale="relative"), sample("b", 1, 50)], GEO)
    assert rows(W.infeasible(g)) == [(1, "a", 1)]


def test_intervals_are_half_open(spark):
    iv = spark.createDataFrame([(1, "m", 0.0, 2.0)], "iv long, k string, start_sec double, end_sec double")
    pts = spark.createDataFrame([("m", 0.0, "start"), ("m", 1.5, "in"), ("m", 2.0, "end")], "k string, t_sec double, id string")
    assert rows(J.last_in_interval(iv, pts, ["k"], "iv", "id", width=1.0)) == [(1, 1.5, "in")]
    assert P.edges_at(iv, 0.0).count() == 1 and P.edges_at(iv, 2.0).count() == 0


def test_asof_takes_the_state_at_the_time_itself(spark):
    states = spark.createDataFrame([("m", 1.0, "x"), ("m", 2.0, "y")], "k string, t_sec double, state string")
    q = spark.createDataFrame([(1, "m", 0.5), (2, "m", 1.0), (3, "m", 1.9), (4, "m", 2.0)], "query_id long, k string, t_sec double")
    assert [r[1] for r in rows(J.asof(q, states, ["k"], ["state"]).select("query_id", "state"), "query_id")] == [None, "x", "x", "y"]


def test_overlap_pairs_come_once(spark):
    iv = spark.createDataFrame([(1, "m", 0.0, 30.0), (2, "m", 5.0, 40.0), (3, "m", 40.0, 41.0)], "id long, k string, start_sec double, end_sec double")
    assert rows(J.overlaps(iv, iv, ["k"], width=4.0).filter("id < r_id").select("id", "r_id")) == [(1, 2)]


def test_al_tags_golden(spark):
    data = [(i, 1, d, c, None) for i, (d, c) in enumerate(zip((0.9, 0.85, 0.0, 0.0, 0.0), (0.1, 0.5, 0.95, 0.95, 0.95)))]
    f = spark.createDataFrame(data, "frame_id long, mission_id long, dist double, caption_confidence double, surprise double")
    assert [r[1] for r in rows(A.al_tags(f, 1, 0.7).select("frame_id", "al_tag"), "frame_id")] == ["needs_annotation", "novel", None, None, None]


def test_tracking_quality_counts_a_switch(spark):
    box = (0.1, 0.1, 0.2, 0.2)
    pred = spark.createDataFrame([(1, "p", float(t), *box) for t in range(4)], "mission_id long, track_id string, t_sec double, x double, y double, w double, h double")
    truth = spark.createDataFrame([(1, g, float(t), *box) for t, g in enumerate("aaab")], "mission_id long, gt_id string, t_sec double, x double, y double, w double, h double")
    row = M.tracking_quality(pred, truth).first()
    assert (row.tp, row.fp, row.fn, row.switches) == (4, 0, 0, 1) and row.hota == pytest.approx(math.sqrt(0.75), abs=1e-6) and row.idf1 == 0.75


def test_pinned_corpus_scores(spark):
    """Seven missions: one empty, one whose track runs on over another object after an occlusion, five without a fault."""
    left, right, tall = (0.1, 0.1, 0.2, 0.2), (0.6, 0.1, 0.2, 0.2), (0.1, 0.2, 0.2, 0.3)
    seen = [  # mission, track, object, time, state, box
        ("crowded", "l", "gl", 0.0, "confirmed", left), ("crowded", "r", "gr", 0.0, "confirmed", right), ("contradiction", "a", "ga", 0.0, "confirmed", left), ("contradiction", "b", "gb", 0.0, "tentative", right),
        ("nominal", "1", "g1", 0.0, "confirmed", tall), ("nominal", "1", "g1", 4.0, "confirmed", tall), ("nominal", "1", None, 8.0, "ended", tall), ("nominal", "3", "g1", 8.0, "confirmed", tall),
        ("occlusion", "bad", "g1", 0.0, "confirmed", left), ("occlusion", "bad", None, 5.0, "occluded", left), ("occlusion", "bad", "g2", 9.0, "confirmed", right), ("relative", "1", "g1", 0.0, "confirmed", left), ("weak", "1", "g1", 0.0, "confirmed", left),
    ]
    kind = "mission_id string, {} string, t_sec double, x double, y double, w double, h double"
    pred = spark.createDataFrame([(m, track, t, *box, 0.9, state) for m, track, _, t, state, box in seen], kind.format("track_id") + ", confidence double, state string").filter(M.ACTIVE).drop("state")
    truth = spark.createDataFrame([(m, g, t, *box) for m, _, g, t, _, box in seen if g], kind.format("gt_id"))
    scores = M.tracking_quality(pred, truth)
    assert {r.mission_id: r.hota for r in scores.collect()} == {m: 0.707107 if m == "occlusion" else 1.0 for m in ("crowded", "contradiction", "nominal", "occlusion", "relative", "weak")}
    row = scores.agg(F.round(F.avg("hota"), 6).alias("hota"), F.round(F.avg("idf1"), 6).alias("idf1"), F.sum("switches").alias("switches")).first()
    assert (row.hota, row.idf1, row.switches) == (0.951185, 0.916667, 1)
    assert {(r.ap, r.recall) for r in M.grounding(pred, truth).collect()} == {(1.0, 1.0)}


def test_greedy_matching_prefers_the_best_pair(spark):
    pred = spark.createDataFrame([(1, "p1", 0.0, 0.0, 0.0, 1.0, 1.0), (1, "p2", 0.0, 0.0, 0.0, 1.0, 0.9)], "mission_id long, track_id string, t_sec double, x double, y double, w double, h double")
    truth = spark.createDataFrame([(1, "g", 0.0, 0.0, 0.0, 1.0, 0.9)], "mission_id long, gt_id string, t_sec double, x double, y double, w double, h double")
    assert rows(M.frame_matches(pred, truth).select("track_id", "gt_id")) == [("p2", "g")]


def test_grounding_average_precision(spark):
    schema = "mission_id long, track_id string, t_sec double, x double, y double, w double, h double, confidence double"
    pred = spark.createDataFrame([(1, "hit", 0.0, 0.0, 0.0, 1.0, 1.0, 0.9), (1, "miss", 0.0, 5.0, 5.0, 1.0, 1.0, 0.8)], schema)
    truth = spark.createDataFrame([(1, "g", 0.0, 0.0, 0.0, 1.0, 1.0), (1, "h", 1.0, 0.0, 0.0, 1.0, 1.0)], "mission_id long, gt_id string, t_sec double, x double, y double, w double, h double")
    row = M.grounding(pred, truth).first()
    assert (row.ap, row.recall) == (0.5, 0.5)


def test_interval_quality(spark):
    pred = spark.createDataFrame([(1, 10, 0.0, 2.0), (1, 11, 0.0, 1.0), (1, 12, 9.0, 9.5)], "mission_id long, pred_id long, start_sec double, end_sec double")
    truth = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 0.5, 1.5)], "mission_id long, truth_id long, start_sec double, end_sec double")
    row = M.interval_quality(pred, truth, ["mission_id"]).first()
    assert row.precision == pytest.approx(2 / 3, abs=1e-6) and row.recall == 1.0


def test_mask_quality_by_hand(spark):
    schema = "mission_id long, mask_id long, width int, height int, bits string"
    row = M.mask_quality(spark.createDataFrame([(1, 1, 3, 3, "111111111")], schema), spark.createDataFrame([(1, 1, 3, 3, "111111000"), (1, 2, 3, 3, "111111111")], schema)).first()
    # 6 of 9 overlap; edges: 8 predicted, 6 true, 5 both
    assert row.j == pytest.approx((6 / 9 + 0) / 2, abs=1e-6) and row.f == pytest.approx(2 * (5 / 8) * (5 / 6) / (5 / 8 + 5 / 6) / 2, abs=1e-6)


def test_cycles_and_chains(spark):
    tail = [(k, k + 1) for k in range(100, 400)] + [(20, 1)]  # a long chain, and one that runs into the cycle
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (8, 9), (50, 50)] + tail, "child long, parent long")
    assert sorted(r[0] for r in G.check_cycles(pairs).collect()) == [1, 2, 3, 50]
    p = spark.createDataFrame([(1, None, "open"), (2, 1, "open"), (3, 2, "accepted"), (4, None, "rejected")], "proposal_id long, supersedes long, status string")
    assert rows(G.effective_status(p).select("proposal_id", "effective_status"), "proposal_id") == [(1, "accepted"), (2, "accepted"), (3, "accepted"), (4, "rejected")]


def test_a_chain_of_any_length_has_its_end(spark):
    chain = [(k, k - 1 if k > 1 else None, "accepted" if k == 300 else "open") for k in range(1, 301)] + [(500, 501, "x"), (501, 500, "y")]
    out = {r.proposal_id: (r.effective_id, r.effective_status) for r in G.effective_status(spark.createDataFrame(chain, "proposal_id long, supersedes long, status string")).collect()}
    assert len(out) == 302 and all(out[k] == (300, "accepted") for k in range(1, 301)) and out[500] == out[501] == (None, None)


def test_tiles_keep_the_first_of_alike_ones(spark):
    data = [(1, 1, 0b1111, [1.0, 0.0], "c1", 0, 0.5), (2, 1, 0b1110, [1.0, 0.01], "c2", 0, 0.9), (3, 1, -1, [0.0, 1.0], "c1", 0, 0.7)]
    tiles = spark.createDataFrame(data, "tile_id long, mission_id long, hash long, vector array<double>, cell string, window int, score double")
    assert [r[0] for r in rows(G.dedupe_tiles(tiles).select("tile_id"), "tile_id")] == [3]


def test_claims_fail_closed(spark):
    texts = [(1, '```json\n[{"claim_kind":"count","text":"two"}]\n```'), (2, '[{"claim_kind":"count","odd":"x"}]'), (3, "no json"), (4, None)]
    good, bad = V.parse_claims(spark.createDataFrame(texts, "text_id long, text string"))
    assert rows(good.select("text_id", "claim_kind")) == [(1, "count")] and sorted(r[0] for r in bad.collect()) == [2, 3, 4]


def test_log_scan_reports_bad_lines(spark, tmp_path):
    lines = ['{"schema_version":"1","a":1}', "oops", '{"schema_version":"1","a":2,"b":3}', '{"schema_version":"0","a":4}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    good, issues = G.read_log(spark, str(tmp_path), "a long", ["a"], "1")
    assert [r.a for r in good.collect()] == [1]
    assert rows(issues.select("line", "code"), "line") == [(2, "not_an_object"), (3, "unknown_field"), (4, "wrong_version")]


def test_tree_trace_and_inventory(spark, tmp_path):
    (tmp_path / "geometry/a").mkdir(parents=True)
    (tmp_path / "geometry/a/1.json").write_text('{"x": 1}')
    assert [r.doc.x for r in G.read_tree(spark, str(tmp_path / "geometry"), "x long").collect()] == [1]
    (tmp_path / "trace.jsonl").write_text('{"t": 1}\n\n[1]\nbad\n{"t": 3, "lat": 1.0, "lon": 2.0}\n')
    assert G.read_trace(spark, str(tmp_path / "trace.jsonl")).count() == 2
    lines = spark.createDataFrame([("f", '{"t": 1}'), ("f", '{"timestamp": 3, "lat": 1.0, "lon": 2.0}'), ("f", "")], "file string, value string")
    row = G.bundle_inventory(lines).first()
    assert (row.rows, row.t_start_sec, row.t_end_sec, tuple(row.origin)) == (2, 1.0, 3.0, (1.0, 2.0))


def test_artifact_audit(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    stored = G.stored_files(spark, str(tmp_path))
    digest = stored.first().digest
    data = [(1, "mask", "a.bin", digest, 3), (1, "log", "b.bin", "x", 1), (1, "log", "../c", "x", 1)]
    issues = G.audit_artifacts(spark.createDataFrame(data, "mission_id long, kind string, path string, digest string, size long"), stored, ["mask", "log", "qa"])
    assert {(r.kind, r.code) for r in issues.collect()} == {("log", "missing"), ("log", "escaping_path"), ("log", "required_once"), ("qa", "required_once")}


def test_append_refuses_repeats(spark, tmp_path):
    path, df = str(tmp_path / "log"), spark.createDataFrame([(1,), (2,)], "id long")
    G.append_log(df, path, "id")
    with pytest.raises(ValueError):
        G.append_log(df.limit(1), path, "id")
    G.append_log(spark.createDataFrame([(3,)], "id long"), path, "id")
    assert spark.read.parquet(path).count() == 3


def test_replace_partition_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    G.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "mission_id long, v string"), path, "mission_id")
    G.replace_partition(spark.createDataFrame([(2, "c")], "mission_id long, v string"), path, "mission_id")
    assert sorted((r.mission_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_replay_log_is_ordered(spark, tmp_path):
    path = str(tmp_path / "replay")
    G.write_replay(spark.createDataFrame([(i % 7, i) for i in range(50)], "t long, id long"), path, ["t", "id"])
    files = sorted(p for p in (tmp_path / "replay").iterdir() if p.suffix == ".json")
    got = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert [(g["t"], g["id"]) for g in got] == sorted((i % 7, i) for i in range(50))


def test_prototype_is_the_recursion(spark):
    rng = __import__("random").Random(2)
    data = [(k, "tu"[k % 2], "s", float(rng.choice([0, 1, 1, 2.5, 4, 7])), [rng.random(), rng.random()]) for k in range(24)]
    e = spark.createDataFrame(data, "observation_id long, track_id string, space string, t_sec double, vector array<double>")
    want = {}
    for k, track, _, t, v in sorted(data, key=lambda d: (d[3], d[0])):
        if track not in want:
            want[track] = (t, v)
        else:
            before, old = want[track]
            w = math.exp((before - t) / 2.0)
            want[track] = (t, [w * x + (1 - w) * y for x, y in zip(old, v)])
    got = {r.track_id: r.prototype for r in A.prototypes(e).collect()}
    assert all(got[k] == pytest.approx(v) for k, (_, v) in want.items()) and set(got) == set(want)


def test_missing_signals_count_as_half(spark):
    data = [(1, 1, 1.0, None, None), (2, 1, 1.0, 0.0, None), (3, 1, None, 0.9, None), (4, 2, 0.0, 0.5, 1.0), (5, 2, 0.0, 0.5, None)]
    f = spark.createDataFrame(data, "frame_id long, mission_id long, dist double, caption_confidence double, surprise double")
    got = {r.frame_id: r.al_score for r in A.al_tags(f, 1, 0.7).collect()}
    assert got == pytest.approx({1: 0.8, 2: 0.8, 3: 0.34, 4: 0.525, 5: 0.325})


def test_replaced_event_by_participant_and_overlap(spark):
    schema = "event_id long, mission_id long, type string, participant string, start_sec double, end_sec double"
    fast = spark.createDataFrame([(1, 1, "a", "x", 0.0, 1.0), (2, 1, "a", "y", 4.0, 9.0), (3, 1, "a", "x", 30.0, 31.0), (4, 1, "b", "x", 5.0, 6.0), (5, 2, "a", "z", 5.0, 6.0)], schema)
    deep = spark.createDataFrame([(10, 1, "a", "x", 5.0, 6.0), (11, 1, "a", "x", 0.5, 40.0), (12, 1, "a", "q", 5.0, 6.0), (13, 1, "a", "q", 20.0, 21.0), (14, 1, "c", "x", 5.0, 6.0), (15, 1, "a", "x", 25.0, 26.0)], schema)
    # 10 shares x with 1 and 3 alone, and 1 is nearer; 11 overlaps 3 longer than 1; 12 shares with none and overlaps 2; 13 overlaps none.
    assert dict(rows(J.superseded_events(deep, fast))) == {10: 1, 11: 3, 12: 2, 13: None, 14: None, 15: 3}


def test_grid_cells_hold_at_every_latitude(spark):
    rng = __import__("random").Random(4)
    places = [(i, rng.choice([0.0, 45.0, 69.9, 80.0, -75.0]) + rng.uniform(-0.2, 0.2), rng.choice([-179.99, 0.0, 179.95, 60.0]) + rng.uniform(-0.2, 0.2)) for i in range(400)]
    places = [(i, lat, (lon + 540) % 360 - 180) for i, lat, lon in places]
    m = spark.createDataFrame(places[:250], "mission_id long, lat double, lon double")
    s = spark.createDataFrame(places[250:], "site_id long, lat double, lon double")
    got = {r.mission_id: r.distance_m for r in J.assign_sites(m, s, 5000.0).collect()}

    def off(a, b):
        apart = (a[2] - b[2] + 540) % 360 - 180
        return math.hypot((a[1] - b[1]) * 111320.0, apart * 111320.0 * math.cos(math.radians(b[1])))

    want = {a[0]: min(off(a, b) for b in places[250:]) for a in places[:250]}
    assert sum(d <= 5000 for d in want.values()) > 40
    assert all((got[i] is None) == (d > 5000) and (got[i] is None or got[i] == pytest.approx(d, abs=1e-3)) for i, d in want.items())


def test_identity_needs_a_gap_or_a_reset(spark):
    data = [(1, "a", "car", 0.0, 5.0, [1.0, 0.0]), (1, "b", "car", 6.0, 9.0, [1.0, 0.1]), (1, "c", "car", 20.0, 21.0, [1.0, 0.0]), (1, "d", "box", 20.0, 21.0, [1.0, 0.0]), (1, "e", "car", 30.0, 31.0, [0.0, 1.0])]
    tracks = spark.createDataFrame(data, "mission_id long, track_id string, label string, born double, ended double, vector array<double>")
    link = lambda r: sorted(rows(I.link_identities(tracks, "vector", r).select("track_id", "linked", "reason")))
    assert link(None) == [("c", "b", "occlusion")]
    resets = spark.createDataFrame([(1, 5.5), (2, 20.0)], "mission_id long, t_sec double")
    assert link(resets) == [("b", "a", "camera_cut"), ("c", "b", "occlusion")]


def test_facts_that_differ(spark):
    changes = spark.createDataFrame([(1, 2), (3, 4)], "id long, reference long")
    facts = spark.createDataFrame([(1, {"road": "wet", "cars": "2"}), (2, {"road": "dry", "cars": "2", "snow": "no"}), (3, {"road": "wet"})], "id long, facts map<string,string>")
    assert rows(J.facts_diff(changes, facts), "id", "key") == [(1, 2, "road", "dry", "wet"), (1, 2, "snow", "no", None), (3, 4, "road", None, "wet")]


def claim(i, predicate=None, text="they met", subject="a", obj="b", start=0.0, end=2.0, kind="action", status="uncertain"):
    return (i, 1, kind, text, predicate, subject, obj, start, end, status)


CLAIM = "claim_id long, mission_id long, claim_kind string, text string, predicate string, subject_id string, object_id string, start_sec double, end_sec double, status string"


def test_claims_by_the_first_rule_that_speaks(spark):
    base = [sample("a", 0, 0), sample("a", 1, 1), sample("b", 0, 5), sample("b", 1, 5, z=1.0), sample("c", 9, 0), sample("far", 0, 0), sample("far", 1, 900), sample("r", 0, 3, scale="relative"), sample("camera", 0, 9)]
    samples = spark.createDataFrame(base, GEO).withColumn("residual_m", F.when((F.col("subject_id") == "b") & (F.col("t_sec") == 1), 0.9)).withColumn("covariance", F.lit(0.1)).withColumn("frame", F.when(F.col("subject_id") == "camera", "camera").otherwise("world"))
    tracks = spark.createDataFrame([(1, "a", "Cars", 0.0, "confirmed"), (1, "b", "car", 0.0, "lost"), (1, "d", "car", 1.0, "tentative"), (1, "d", "car", 5.0, "ended")], "mission_id long, track_id string, label string, t_sec double, state string")
    nodes = spark.createDataFrame([(1, "a"), (1, "b")], "mission_id long, node_id string")
    links = spark.createDataFrame([(1, "a")], "mission_id long, track_id string")
    edges = spark.createDataFrame([(1, 1, "a", "b", "left_of", "accepted", 0.0, 5.0)], "edge_id long, mission_id long, subject_id string, object_id string, predicate string, status string, start_sec double, end_sec double")
    cases = {
        ("accepted", None): [claim(1, "same_as"), claim(2, text="2 cars wait", start=1.0), claim(3, text="one car", start=0.0), claim(4, "left_of", end=1.0), claim(5, "distance_band", "2 m to 8.5 meters apart", end=1.0), claim(6, "visible", end=1.0)],
        ("uncertain", "vlm_not_sole_evidence"): [claim(10, "same_as", subject="b"), claim(11, kind="event"), claim(12, text="The same object again", subject="b")],
        ("rejected", "count_mismatch"): [claim(20, text="three cars", start=1.0), claim(21, text="zero cars", start=9.0)],
        ("rejected", "dangling_id"): [claim(30, "left_of", obj="nobody"), claim(31, obj="nobody")],
        ("rejected", "lifetime_disjoint"): [claim(40, "left_of", obj="c")], ("uncertain", "missing_geometry"): [claim(41, "left_of", subject="d", obj="d")],
        ("uncertain", "metric_scale_missing"): [claim(50, "supports", obj="r")], ("uncertain", "uncertainty_gate"): [claim(51, "left_of", start=0.5, end=2.0), claim(52, "left_of", obj="far", end=1.0)],
        ("uncertain", "missing_distance_band"): [claim(60, "distance_band", end=1.0), claim(62, "distance_band", "8-2 m", end=1.0)], ("uncertain", "missing_evidence"): [claim(61, "visible", subject="b", obj="a", end=1.0)],
        ("rejected", "geometry_contradiction,mutually_exclusive"): [claim(70, "right_of", end=1.0)], ("rejected", "geometry_contradiction"): [claim(71, "above", end=1.0)], ("rejected", "geometry_contradiction,geometry_overrides_confidence,mutually_exclusive"): [claim(72, "right_of", end=1.0, status="accepted")],
        ("rejected", "mixed_coordinate_frame"): [claim(73, "left_of", obj="camera", end=1.0)],
        ("uncertain", None): [claim(80), claim(81, subject=None, obj=None)],
    }
    df = spark.createDataFrame([c for cs in cases.values() for c in cs], CLAIM)
    got = {r.claim_id: (r.status, ",".join(r.reasons) or None, r.needs_review) for r in V.verify_claims(df, tracks, nodes, links, samples, edges, spark.createDataFrame([(1,)], "mission_id long")).collect()}
    assert got == {c[0]: (*verdict, verdict == ("uncertain", None)) for verdict, cs in cases.items() for c in cs}


def test_counts_in_words(spark):
    texts = ["Two-cars wait", "3 persons", "eleven cars", "car", "ten  buses here", "", None, "12 s"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(*[c.alias(n) for c, n in zip(V.said_count(F.col("text")), ("n", "l"))])
    assert rows(df) == [(2, "car"), (3, "person"), (None, None), (None, None), (10, "buse"), (None, None), (None, None), (None, None)]


def test_interval_events(spark):
    e = spark.createDataFrame([(1, 1, "zone", "a", "contains", "", 0.0, 1.0, "x"), (2, 1, "b", "a", "contains", "", 0.0, 1.0, "x"), (3, 1, "a", "b", "distance_band", "0.000-2.000", 2.0, 3.0, "x"), (4, 1, "a", "b", "distance_band", "2.000-8.000", 2.0, 3.0, "x"), (5, 1, "b", "a", "supports", "", 3.0, 4.0, "x"), (6, 1, "zone", "b", "contains", "", 0.0, 9.0, "x")],
                              "edge_id long, mission_id long, subject_id string, object_id string, predicate string, band string, start_sec double, end_sec double, evidence_id string")
    s = spark.createDataFrame([sample("a", t, 0) for t in (0, 1.5, 2)] + [sample("b", 1, 0)], GEO)
    got = sorted((r.edge_id, r.type, tuple(r.participants), r.start_sec) for r in V.edge_events(e, s, spark.createDataFrame([(1, "zone")], "mission_id long, region_id string")).collect())
    assert got == [(1, "entered_region", ("a", "zone"), 0.0), (1, "left_region", ("a", "zone"), 1.5), (3, "approached", ("a", "b"), 2.0), (5, "put_down", ("a", "b"), 3.0), (6, "entered_region", ("b", "zone"), 0.0)]


def test_answers_only_where_there_is_one(spark):
    schema = "event_id long, mission_id long, type string, participants array<string>, label string, start_sec double, status string, n_evidence long, evidence_ref string"
    events = spark.createDataFrame([
        (1, 1, "entered_region", ["a", "zone"], None, 1.0, "accepted", 1, None), (2, 1, "entered_region", ["a", "yard"], None, 1.0, "accepted", 1, None), (3, 1, "entered_region", ["b", "yard"], None, 2.0, "accepted", 1, None), (4, 1, "put_down", ["a", "b"], None, 3.0, "accepted", 0, None),
        (5, 1, "picked_up", ["b", "a"], None, 3.0, "accepted", 2, "geometry/b"), (6, 1, "count_changed", ["a", "b"], "Cars", 4.0, "accepted", 1, "geometry/x"), (7, 1, "count_changed", ["a"], "car", 9.0, "accepted", 1, None), (8, 1, "count_changed", ["p"], "person", 2.0, "accepted", 1, None), (9, 1, "approached", ["a", "b"], None, 0.0, "rejected", 1, "geometry/r"),
    ], schema)
    tracks = spark.createDataFrame([(1, "a", "car", 0.0), (1, "b", "cars", 0.0), (1, "p", "box", 0.0)], "mission_id long, track_id string, label string, t_sec double")
    edges = spark.createDataFrame([(1, "a", "left_of", "b", "accepted"), (1, "b", "left_of", "c", "accepted"), (1, "a", "left_of", "c", "accepted"), (1, "q", "left_of", "d", "accepted"), (1, "b", "left_of", "a", "rejected")], "mission_id long, subject_id string, predicate string, object_id string, status string")
    got = sorted((r.template, r.about, r.answer, r.cite) for r in V.answers(events, tracks, edges).collect())
    assert got == [("count", "car", "2", 6), ("entered", "zone", "a", 1), ("evidence", "5", "geometry/b", 5), ("left_of", "b", "a", 1), ("state_change", "picked_up a", "b", 5)]


def test_a_run_that_is_pointed_at_stays(spark, tmp_path):
    run = lambda i, over=None: spark.createDataFrame([(i, over)], "run_id long, supersedes_run_id long")
    rows_of = lambda i, ids: spark.createDataFrame([(i, k) for k in ids], "run_id long, id long")
    folder = str(tmp_path)
    for i, ids, over in ((1, [1, 2], None), (2, [3], 1), (2, [4, 5], 1), (2, [], 1)):
        G.replace_run({"run": run(i, over), "events": rows_of(i, ids)}, folder)
        stored = sorted((r.run_id, r.id) for r in G.read_runs(spark, folder, "events").collect())
        assert stored == [(1, 1), (1, 2)] + [(2, k) for k in (ids if i == 2 else [])]
    with pytest.raises(ValueError):
        G.replace_run({"run": run(1), "events": rows_of(1, [9])}, folder)
    with pytest.raises(ValueError):
        G.replace_run({"run": run(5), "events": rows_of(6, [9])}, folder)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from missionspark.sources.storage import shared_dir

    def session(master, folder=None):
        context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: folder, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))

    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y" and shared_dir(session("local[2]"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_motion_fusion_shifts_to_the_newest_centre(spark):
    data = [(1, "a", 0.0, True, 0.0, 0.0, 0.0), (1, "a", 1.0, True, 5.0, 0.0, 0.0), (1, "b", 0.0, False, 1.0, 1.0, 1.0), (1, "a", -3.0, True, 9.0, 9.0, 9.0)]
    p = spark.createDataFrame(data, "mission_id long, subject_id string, t_sec double, dynamic boolean, x double, y double, z double")
    assert sorted((r.subject_id, r.x) for r in A.fuse_motion(p).collect()) == [("a", 5.0), ("a", 5.0), ("b", 1.0)]
