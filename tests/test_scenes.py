"""Point clouds, cameras, rechecks and degradations on literal cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from missionspark.operators import cloud as C
from missionspark.operators import graph as V


def test_box_of_a_turned_rectangle(spark):
    a = math.radians(30)
    ground = [(x / 4, y / 4) for x in range(17) for y in range(9)]
    points = [("t", 0.0, 5 + x * math.cos(a) - y * math.sin(a), 1 + x * math.sin(a) + y * math.cos(a), z) for x, y in ground for z in (0.0, 0.5, 1.0)]
    out = C.box_fit(spark.createDataFrame(points + [("t", 0.0, 500.0, 0.0, 0.0), ("few", 0.0, 0.0, 0.0, 0.0)], "track_id string, t_sec double, x double, y double, z double")).collect()
    assert len(out) == 1 and out[0].n == len(points)
    assert sorted((out[0].length, out[0].width)) == pytest.approx([2.0, 4.0], abs=1e-6) and out[0].height == 1.0 and out[0].yaw % 90 == pytest.approx(30.0)
    # By definition: variance of the points over their number, deviation of their distance to the median point.
    x, y, z = np.array([p[2:] for p in points]).T
    far = np.sqrt((x - np.median(x)) ** 2 + (y - np.median(y)) ** 2 + (z - np.median(z)) ** 2)
    assert [out[0].var_x, out[0].var_y, out[0].var_z] == pytest.approx([c.var() / len(points) for c in (x, y, z)])
    assert out[0].residual == pytest.approx(np.median(np.abs(far - np.median(far))))


def test_flat_cloud_has_the_least_height(spark):
    flat = [("t", 0.0, x / 4, y / 4, 1.0) for x in range(5) for y in range(5)]
    out = C.box_fit(spark.createDataFrame(flat, "track_id string, t_sec double, x double, y double, z double")).collect()
    assert out[0].height == 0.001 and out[0].var_z == 0.0 and out[0].cz == 1.0


def test_a_turned_camera(spark):
    quarter = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    kind = "camera_id long, fu double, fv double, cu double, cv double, k1 double, k2 double, px double, py double, pz double, calibrated boolean, rotation array<double>"
    cameras = spark.createDataFrame([(0, 100.0, 100.0, 0.0, 0.0, 0.0, 0.0, 10.0, 20.0, 30.0, True, quarter)], kind)
    pixels = [("a", 0.0, 0, 100.0, 200.0, 2.0, True), ("a", 0.0, 0, 100.0, 200.0, 1e-7, True), ("b", 0.0, 0, 0.0, 0.0, 1.0, True)]
    points = C.backproject(spark.createDataFrame(pixels, "track_id string, t_sec double, camera_id long, u double, v double, depth double, mask boolean"), cameras)
    assert sorted((r.track_id, r.x, r.y, r.z) for r in points.collect()) == [("a", 14.0, 18.0, 32.0), ("b", 10.0, 20.0, 31.0)]
    assert sorted((r.track_id, r.error_px, r.n) for r in C.reprojection_error(points).collect()) == [("a", 0.0, 1), ("b", 0.0, 1)]


def test_pixels_go_out_and_back(spark):
    cameras = spark.createDataFrame([(0, 500.0, 500.0, 320.0, 240.0, 0.05, 0.01, 0.0, 0.0, 0.0, True), (1, 500.0, 500.0, 320.0, 240.0, 0.0, 0.0, 0.0, 0.0, 0.0, False)], "camera_id long, fu double, fv double, cu double, cv double, k1 double, k2 double, px double, py double, pz double, calibrated boolean")
    pixels = [("a", 0.0, 0, 420.0, 140.0, 2.0, True), ("a", 0.0, 0, 1.0, 1.0, 2.0, False), ("a", 0.0, 0, 1.0, 1.0, float("nan"), True), ("b", 0.0, 1, 320.0, 240.0, 3.0, True)] + [("c", 0.0, 1, 320.0, 240.0, float(k), True) for k in range(1, 14)]
    out = C.backproject(spark.createDataFrame(pixels, "track_id string, t_sec double, camera_id long, u double, v double, depth double, mask boolean"), cameras).collect()
    own = [r for r in out if r.track_id == "a"]
    assert len(own) == 1 and own[0].reprojection_px < 1e-6 and own[0].z == 2.0
    assert not [r for r in out if r.track_id == "b"]  # too few pixels for a scale
    assert sorted(r.z for r in out if r.track_id == "c")[6] == 1.0


SAMPLE = "mission_id long, subject_id string, sample_id string, t_sec double, cx double, cy double, cz double, ex double, ey double, ez double, depth_m double, metric_scale string, calibration_id string, residual_m double, covariance double"


def sample(subject, t, x, z=0.0, scale="metric", residual=None, covariance=0.1, mission=1):
    return (mission, subject, f"{subject}@{t}", float(t), float(x), 0.0, z, 1.0, 1.0, 1.0, 1.0, scale, "cal", residual, covariance)


def test_recheck_by_the_first_cited_edge_that_fails(spark):
    samples = spark.createDataFrame(
        [sample("a", 0, 0), sample("b", 0, 5), sample("a", 1, 0), sample("b", 1, -5), sample("late", 9, 0), sample("noisy", 0, 9, residual=0.9), sample("spread", 0, 9, covariance=2.0), sample("rel", 0, 9, scale="relative")], SAMPLE
    )
    edge = lambda i, s, p, o, start=0.0, end=0.5, low=None, high=None, m=1: (m, i, s, p, o, start, end, low, high)
    edges = spark.createDataFrame(
        [edge("ok", "a", "left_of", "b"), edge("no", "a", "left_of", "b", 1.0, 2.0), edge("unseen", "a", "left_of", "late"), edge("noise", "a", "left_of", "noisy"), edge("spread", "a", "left_of", "spread"), edge("spread-band", "a", "distance_band", "spread", low=0.0, high=20.0),
         edge("band", "a", "distance_band", "b", low=2.0, high=8.0), edge("far", "a", "distance_band", "b", low=0.0, high=2.0), edge("relative", "a", "distance_band", "rel", low=0.0, high=20.0), edge("seen", "a", "visible", "b"), edge("odd", "a", "next_to", "b"), edge("moved", "b", "relative_motion", "a", 0.0, 2.0), edge("plain", "a", "contacts", "b", m=2)],
        "mission_id long, delta_id string, subject_id string, predicate string, object_id string, start_sec double, end_sec double, band_low double, band_high double",
    )
    tracks = spark.createDataFrame([(1, "a"), (1, "b")], "mission_id long, track_id string")
    cases = {
        ("accepted", "r", ""): [["ok"], ["ok", "band"], ["seen"], ["spread"], ["moved"], ["nobody", "ok"]], ("rejected", "left_of,geometry", "geometry_contradiction"): [["no"], ["ok", "no", "unseen"]],
        ("uncertain", "left_of", "missing_geometry"): [["unseen", "no"]], ("uncertain", "left_of", "uncertainty_gate"): [["noise"]], ("uncertain", "distance_band", "uncertainty_gate"): [["spread-band"], ["relative"]],
        ("rejected", "distance_band,geometry", "geometry_contradiction"): [["far"]], ("rejected", "next_to,geometry", "geometry_contradiction"): [["odd"]], ("uncertain", "r", "unrecomputed"): [[], ["nobody"]],
    }
    events = [(f"e{n}-{k}", 1, "accepted", ["r"], [], ["a"], refs, want) for n, (want, all_refs) in enumerate(cases.items()) for k, refs in enumerate(all_refs)]
    events += [
        ("old", 1, "uncertain", ["x"], ["y"], ["a"], ["no"], ("uncertain", "x", "y")), ("count", 1, "accepted", ["track_count"], [], ["a", "b"], [], ("accepted", "track_count", "")), ("strange", 1, "accepted", ["track_count"], [], ["a", "z"], [], ("rejected", "track_count", "dangling_id")),
        ("unmetric", 2, "accepted", ["r"], [], ["a"], ["plain"], ("uncertain", "contacts", "metric_scale_missing")), ("bare", 1, "accepted", ["r"], [], ["a"], ["ok"], ("rejected", "r", "missing_evidence")), ("half", 1, "accepted", ["r"], [], ["a"], ["ok"], ("rejected", "r", "missing_evidence")),
    ]
    df = spark.createDataFrame([e[:7] for e in events], "event_id string, mission_id long, status string, rules array<string>, reasons array<string>, participants array<string>, refs array<string>")
    proofs = [(e[1], e[0], f"g/{e[0]}", None) for e in events if e[0] != "bare"] + [(1, "half", None, "m/gone"), (1, "count", None, "m/there")]
    evidence = spark.createDataFrame(proofs, "mission_id long, event_id string, geometry_ref string, mask_ref string")
    files = spark.createDataFrame([(p[0], p[2]) for p in proofs if p[2]] + [(1, "m/there"), (2, "m/gone")], "mission_id long, path string")
    out = V.recheck(V.evidenced(df, evidence, files), edges, samples, tracks, spark.createDataFrame([(1,)], "mission_id long"))
    assert {r.event_id: (r.status, ",".join(r.rules), ",".join(r.reasons)) for r in out.collect()} == {e[0]: e[7] for e in events}


def test_claims_against_the_nearest_samples(spark):
    samples = spark.createDataFrame([sample("a", 0, 0), sample("a", 4, 9), sample("b", 1, 5), sample("b", 3, 2)], SAMPLE)
    told = {1: ("left_of", 9.0), 2: ("right_of", 0.0), 3: ("left_of", None), 4: ("distance_band", 0.0), 5: ("relative_motion", 0.0)}
    fine = {6: ("left_of", 0.0), 7: ("right_of", None), 8: ("visible", 1.0), 9: ("next_to", 1.0), 10: ("left_of", 2.0)}  # at 2.0 the earlier of equals
    rows = [(k, 1, p, "a", "b", t) for k, (p, t) in (told | fine).items()] + [(11, 1, "right_of", "a", "nobody", 0.0), (12, 1, "right_of", None, "b", 0.0)]
    claims = spark.createDataFrame(rows, "claim_id long, mission_id long, predicate string, subject_id string, object_id string, start_sec double")
    assert sorted(r.claim_id for r in V.screen_claims(claims, samples).collect()) == sorted(told)


TRACKS = "mission_id long, track_id string, label string, t_sec double, state string"


def test_count_events_from_claims(spark):
    tracks = spark.createDataFrame([(1, "b", "Cars", 0.0, "tentative"), (1, "a", "car", 0.0, "occluded"), (1, "c", "car", 0.0, "lost"), (1, "p", "person", 0.0, "confirmed"), (1, "q", "dog", 0.0, "confirmed")], TRACKS)
    samples = spark.createDataFrame([sample("node", 2, 0), sample("node", 1, 0), sample("p", 0, 0)], SAMPLE)
    nodes = spark.createDataFrame([(1, "node", "a")], "mission_id long, node_id string, track_id string")
    events = spark.createDataFrame([(1, "evt-count-car-0003000", "approached", ["x"]), (1, "e2", "count_changed", ["p"]), (2, "e3", "count_changed", ["a", "b"])], "mission_id long, event_id string, type string, participants array<string>")
    texts = {1: ("two cars", 1.5), 2: ("two cars", 3.0), 3: ("three cars", 1.5), 4: ("one person", 1.5), 5: ("one dog", 1.5), 6: ("2 cars wait", None), 7: ("cars", 1.0)}
    claims = spark.createDataFrame([(k, 1, text, t) for k, (text, t) in texts.items()], "claim_id long, mission_id long, text string, start_sec double")
    out = {r.event_id: (r.ids, r.n, r.start_sec, r.evidence_id) for r in V.claim_count_events(claims, tracks, nodes, samples, events).collect()}
    assert out == {"evt-count-car-0001500": (["a", "b"], 2, 1.5, "node@1"), "evt-count-car-0001000": (["a", "b"], 2, 1.0, "node@1")}


def test_audit_rows_name_what_they_replace(spark):
    schema = "claim_id long, status string, reasons array<string>"
    before = spark.createDataFrame([(1, "uncertain", []), (2, "accepted", ["x"]), (3, "accepted", None), (4, "accepted", ["x"])], schema)
    after = spark.createDataFrame([(1, "accepted", []), (2, "accepted", ["y"]), (3, "accepted", []), (4, "accepted", ["x"])], schema)
    assert sorted((r.claim_id, r.supersedes, r.status, r.reasons) for r in V.audit(before, after).collect()) == [("audit-1", 1, "accepted", []), ("audit-2", 2, "accepted", ["y"])]


def test_active_states(spark):
    from missionspark.operators import aggregates as A
    from missionspark.operators import intervals as W
    from missionspark.operators import metrics as M

    tracks = spark.createDataFrame([(1, "a", "car", 0.0, "tentative"), (1, "b", "car", 0.0, "occluded"), (1, "c", "car", 0.0, "lost"), (1, "d", "car", 0.0, "ended")], TRACKS)
    assert [r.ids for r in W.count_changes(tracks).collect()] == [["a", "b"]]
    counts = spark.createDataFrame([(1, 0.0, "car", 2), (1, 1.0, "car", 1)], "mission_id long, t_sec double, label string, counted long")
    assert [(r.t_sec, r.counted, r.active) for r in A.count_disagreement(tracks, counts).collect()] == [(1.0, 1, 0)]
    one = tracks.filter("track_id in ('a', 'b')")
    truth = counts.filter("t_sec = 0").select("mission_id", "t_sec", "label", (F.col("counted") - 1).alias("count"))
    assert M.count_mae(one, truth).first().mae == 0.0  # an occluded box isn't found
    events = V.count_events(tracks, spark.createDataFrame([sample("a", 5, 0), sample("a", 3, 0)], SAMPLE)).collect()
    assert [(e.event_id, e.evidence_id, e.n) for e in events] == [("evt-count-car-0000000", "a@3", 2)]
    assert not V.count_events(tracks, spark.createDataFrame([sample("b", 0, 0)], SAMPLE)).collect()


def test_picked_up_compares_first_of_all_with_first_after(spark):
    edges = spark.createDataFrame([(1, k, "supports", f"cup{k}", 1.0) for k in range(3)], "mission_id long, edge_id long, predicate string, object_id string, end_sec double")
    samples = spark.createDataFrame([sample("cup0", 0, 0), sample("cup0", 1, 0.01), sample("cup0", 2, 1.0), sample("cup1", 0, 0), sample("cup1", 1.5, 1.0), sample("cup2", 2, 1.0)], SAMPLE)
    assert [(r.edge_id, r.start_sec) for r in V.picked_up(edges, samples).collect()] == [(1, 1.5)]


def test_places_from_the_centre_of_a_box(spark):
    from missionspark.operators import joins as J

    poses = spark.createDataFrame([(1, 0.0, 100.0, 200.0)], "mission_id long, t_sec double, east double, north double")
    boxes = {"half": (0.4, 0.4, 0.2, 0.2, 100.0, 200.0), "corner": (0.9, 0.8, 0.4, 0.6, 105.0, 195.0), "top": (0.0, -0.5, 0.2, 0.2, 96.0, 205.0)}
    rows = spark.createDataFrame([(k, 1, 1.0, *v[:4], 10.0) for k, v in boxes.items()], "observation_id string, mission_id long, t_sec double, x double, y double, w double, h double, range_m double")
    assert {r.observation_id: pytest.approx((r.east_m, r.north_m)) for r in J.georeference(rows, poses).collect()} == {k: v[4:] for k, v in boxes.items()}


def test_degradations(spark):
    missions = spark.createDataFrame([(1,), (2,)], "mission_id long")
    out = V.degradations(missions, {"depth": None, "mask": missions.filter("mission_id = 1")})
    assert sorted(map(tuple, out.collect())) == [(1, "depth", "provider_unavailable"), (2, "depth", "provider_unavailable"), (2, "mask", "no_result")]


def test_distance_to_the_nearest_centroid(spark):
    data = [(k, [10.0 * (k % 3), 0.1 * (k // 3)]) for k in range(30)]
    out = C.centroid_distance(spark.createDataFrame(data, "id long, vector array<double>"), most=3).collect()
    by_cluster = {}
    for r in out:
        by_cluster.setdefault(r.cluster, []).append(r.id)
    assert sorted(map(sorted, by_cluster.values())) == [[k for k in range(30) if k % 3 == j] for j in range(3)]
    assert all(r.distance == pytest.approx(abs(0.1 * (r.id // 3) - 0.45)) for r in out)  # ten points a tenth apart


def test_baseline_comparison_counts_each_side(spark):
    from missionspark.operators import metrics as M

    schema = "mission_id long, {} long, subject_id string, predicate string, object_id string, start_sec double, end_sec double"
    truth = spark.createDataFrame([(1, 1, "a", "left_of", "b", 0.0, 4.0), (1, 2, "a", "above", "b", 0.0, 4.0)], schema.format("truth_id"))
    ours = spark.createDataFrame([(1, 1, "a", "left_of", "b", 0.0, 4.0), (1, 2, "a", "above", "b", 0.0, 3.0), (1, 3, "a", "left_of", "c", 0.0, 4.0)], schema.format("pred_id"))
    keys = ["mission_id", "subject_id", "predicate", "object_id"]
    row = M.interval_quality(ours, truth, keys).first()
    assert row.precision == pytest.approx(2 / 3)
    assert M.interval_quality(ours.filter("pred_id = 3"), truth, keys).first().precision == 0.0


def test_visible_from_regions_and_node_deltas(spark):
    from missionspark.operators import intervals as W

    samples = spark.createDataFrame([sample(s, t, x) for s, x in (("a", 0), ("b", 3), ("zone", 9)) for t in (0, 1, 2)], SAMPLE)
    states = {("a", 0.0): "tentative", ("a", 1.0): "occluded", ("a", 2.0): "lost", ("b", 0.0): "lost", ("b", 1.0): "confirmed"}
    tracks = spark.createDataFrame([(1, s, f"{s}-{t}", "Cup" if t else "cup", t, state) for (s, t), state in states.items()], "mission_id long, track_id string, observation_id string, label string, t_sec double, state string")
    told = lambda df: sorted((r.subject_id, r.object_id, r.start_sec, r.end_sec) for r in df.filter("predicate = 'visible'").collect())
    assert told(W.relation_intervals(samples, tracks)) == [("a", "zone", 0.0, 2.0), ("b", "zone", 1.0, 2.0)]
    regions = spark.createDataFrame([(1, "b"), (2, "a")], "mission_id long, region_id string")
    assert told(W.relation_intervals(samples, tracks, regions)) == [("a", "b", 0.0, 2.0), ("a", "zone", 0.0, 2.0), ("b", "zone", 1.0, 2.0)]
    assert not told(W.relation_intervals(samples))
    links = spark.createDataFrame([(1, "b", "a"), (1, "a", "b")], "mission_id long, track_id string, linked string")
    nodes = {r.node_id: (r.op, r.kind, r.label, r.track_id, r.supersedes, r.t_sec) for r in V.node_deltas(tracks, samples, regions, links).collect()}
    assert nodes == {"a": ("add", "track", "Cup", "a", None, 0.0), "b": ("supersede", "region", "Cup", "b", "delta-node-a", 0.0), "zone": ("add", "region", "zone", None, None, 0.0)}


def test_claims_borne_out_under_either_name(spark):
    from missionspark.operators import joins as J

    claims = spark.createDataFrame([(1, 1, "a", 0.0, 2.0), (2, 1, "node-a", 0.0, 2.0), (3, 1, "a", 5.0, 6.0), (4, 1, "b", 0.0, 2.0), (5, 2, "node-a", 0.0, 2.0), (6, 1, None, 0.0, 2.0), (7, 1, "a", None, 2.0)], "claim_id long, mission_id long, subject_id string, start_sec double, end_sec double")
    events = spark.createDataFrame([(1, ["x", "node-a"], 1.0, 3.0, "accepted", 1), (2, ["a"], 1.0, 3.0, "accepted", 1), (1, ["b"], 1.0, 3.0, "accepted", 0), (1, ["b"], 1.0, 3.0, "rejected", 1)], "mission_id long, participants array<string>, start_sec double, end_sec double, status string, n_evidence long")
    aliases = spark.createDataFrame([(1, "node-a", "a"), (1, "b", "b"), (1, "c", None)], "mission_id long, node_id string, track_id string")
    assert sorted(r.claim_id for r in J.supported_claims(claims, events, aliases).collect()) == [1, 2]


def test_lookups_of_incoming_files(spark):
    from missionspark.operators import joins as J

    files = spark.createDataFrame([(1, "d1", "u9", 5), (2, "d9", "u1", 5), (3, None, "u1", 5), (4, None, None, 5), (5, None, None, 6), (6, None, None, None)], "file_id long, digest string, url string, size long")
    processed = spark.createDataFrame([(10, "d1", "u1", 5, 1.0), (11, "d2", None, 5, 3.0), (12, "d3", None, 5, 2.0)], "id long, digest string, url string, size long, updated_at double")
    got = {r.file_id: (r.status, r.reason, r.existing) for r in J.precheck(files, processed).collect()}
    assert got == {1: ("duplicate", "hash", 10), 2: ("new", "hash", None), 3: ("duplicate", "url", 10), 4: ("duplicate", "size", 11), 5: ("new", "size", None), 6: ("error", "hash_failed", None)}


def test_corpus_roll_up_and_summary(spark):
    from missionspark.operators import aggregates as A
    from missionspark.operators import metrics as M

    rows = spark.createDataFrame([(1, True, 0.5, 2.0, 4.0, ["cut", "other"]), (2, True, None, 3.0, 9.0, None), (3, False, 99.0, 99.0, 99.0, ["dark"])], "mission_id long, valid boolean, hota double, identity_switches double, queue_depth double, conditions array<string>")
    row = M.roll_up(rows, ["hota"], ["identity_switches"], ["queue_depth"], ["dark", "cut"]).first()
    assert (row.missions, row.hota, row.identity_switches, row.max_queue_depth, row.missing) == (2, 0.5, 5.0, 9.0, ["dark"])
    tracks = spark.createDataFrame([(1, "a", "car"), (1, "a", "car"), (1, "b", "cup")], "mission_id long, track_id string, label string")
    events = spark.createDataFrame([(1, "accepted"), (1, "rejected")], "mission_id long, status string")
    runs = spark.createDataFrame([(1, "fast", "metric", ["mask", "depth", "mask"]), (2, "deep", None, None)], "mission_id long, profile string, metric_scale string, degradations array<string>")
    got = {r.mission_id: (r.tracks, r.observations, r.labels, r.accepted_events, r.samples, r.metric_scale, r.degradations) for r in A.mission_summary(tracks, events, tracks.filter("label = 'cup'"), runs).collect()}
    assert got == {1: (2, 3, {"car": 2, "cup": 1}, 1, 1, "metric", ["depth", "mask"]), 2: (0, 0, {}, 0, 0, "unavailable", [])}


def test_context_documents(spark, tmp_path):
    import json

    samples = spark.createDataFrame([sample("b]", 1, 5), sample("b]", 0, 4), sample("zone", 0, 9), sample("a", 0, 1), sample("quiet", 0, 2), sample("zone", 0, 3, mission=2)], SAMPLE)
    tracks = spark.createDataFrame([(1, "a", "o1", 'the "cup"', 0.0), (1, "b]", "o2", "old", 0.0), (1, "b]", "o3", "car]", 1.0)], "mission_id long, track_id string, observation_id string, label string, t_sec double")
    edges = spark.createDataFrame([(1, 7, "a", "left_of", "b]", 0.5, 2.0), (1, 6, "a", "above", "b]", 0.5, 1.0), (3, 1, "x", "above", "y", 0.0, 1.0)], "mission_id long, edge_id long, subject_id string, predicate string, object_id string, start_sec double, end_sec double")
    nodes = spark.createDataFrame([(1, "quiet", "track"), (1, "zone", "region")], "mission_id long, node_id string, kind string")
    V.write_contexts(V.context_lines(tracks, samples, edges, nodes), str(tmp_path / "c"))
    docs = {}
    for folder in (tmp_path / "c").glob("mission_id=*"):
        (file,) = folder.glob("*.txt")
        docs[int(folder.name.split("=")[1])] = json.loads(file.read_text())
    point = lambda t, x, **more: {"center_m": [x, 0.0, 0.0], "extent_m": [1.0, 1.0, 1.0], "t_sec": t, **more}
    edge = lambda p, end: {"end_sec": end, "object_id": "b]", "predicate": p, "start_sec": 0.5, "subject_id": "a"}
    assert docs[1] == {
        "edges": [edge("above", 1.0), edge("left_of", 2.0)], "regions": [point(0.0, 9.0, node_id="zone")],
        "trajectories": [{"label": 'the "cup"', "samples": [point(0.0, 1.0)], "track_id": "a"}, {"label": "car]", "samples": [point(0.0, 4.0), point(1.0, 5.0)], "track_id": "b]"}, {"label": "quiet", "samples": [point(0.0, 2.0)], "track_id": "quiet"}],
    }
    assert docs[2] == {"edges": [], "regions": [point(0.0, 3.0, node_id="zone")], "trajectories": []} and docs[3]["regions"] == [] and len(docs[3]["edges"]) == 1
