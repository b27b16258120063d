"""Order statistics, hash buckets, numbered logs and replaced runs."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from missionspark.operators import aggregates as A
from missionspark.operators import logs as G
from missionspark.operators import ranking as K
from missionspark.sources import commits


def test_order_statistics_as_by_sorting(spark):
    rng = random.Random(1)
    values = {1: [rng.gauss(0, 1) for _ in range(3_000)], 2: [1.0] * 50, 3: [-1e308, 0.0, 1e-300, 2e-300, 1e308], 4: [7.5], None: [rng.choice([1.0, 2.0, 3.0]) for _ in range(99)], 5: [1e9 + k * 1e-6 for k in range(500)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(1, None), (6, None)], "k long, v double")
    out = A.order_statistics(df, ["k"], "v", {"low": F.lit(0), "mid": F.ceil(F.col("n") / 2), "high": F.col("n") + 9}).collect()
    assert len(out) == 3 * len(values)
    for r in out:
        ordered = sorted(values[r.k])
        place = {"low": 1, "mid": math.ceil(len(ordered) / 2), "high": len(ordered)}[r.which]
        assert (r.value, r.n) == (ordered[place - 1], len(ordered))
    ranks = {r.k: r.percentile for r in K.nearest_rank(df, ["k"], "v", 0.95).collect()}
    assert ranks == {k: sorted(v)[max(1, math.ceil(0.95 * len(v))) - 1] for k, v in values.items()}


def test_percentile_plan_holds_no_values(spark):
    frames = spark.createDataFrame([(None, None, float(k), None) for k in range(101)] + [("c", None, None, None), (None, "dark", None, None)], "caption string, caption_skip_reason string, caption_confidence double, x string")
    found = A.caption_health(frames)
    assert found.first().p95_confidence == 95.0 and "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    empty = A.caption_health(frames.filter("false")).first()
    assert empty.total == 0 and empty.p95_confidence is None and empty.null_rate is None


@pytest.mark.parametrize("bucket_rows", [3, 2_000])
def test_hamming_pairs_of_crowded_bands(spark, bucket_rows):
    rng = random.Random(2)
    base = [rng.getrandbits(48) for _ in range(12)]
    hashes = [b ^ sum(1 << rng.randrange(48) for _ in range(rng.randrange(9))) & ((1 << 48) - 1) for b in base for _ in range(12)]
    rows = [(k % 2 if k % 10 else None, k, h) for k, h in enumerate(hashes)]
    for radius in (0, 3, 6):
        want = [(m, a, b, bin(x ^ y).count("1")) for (m, a, x), (n, b, y) in itertools.combinations(rows, 2) if m == n and bin(x ^ y).count("1") <= radius]
        got = G.hamming_pairs(spark.createDataFrame(rows, "mission_id long, tile_id long, hash long"), radius, 48, ["mission_id"], bucket_rows).collect()
        key = lambda r: tuple(-1 if v is None else v for v in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    full = spark.createDataFrame([(k, (1 << 63) - 1 - (1 << k)) for k in range(40)], "tile_id long, hash long")
    assert G.hamming_pairs(full, 2, 64, bucket_rows=bucket_rows).count() == 40 * 39 / 2


def test_lines_of_split_files(spark, tmp_path):
    rng = random.Random(3)
    lines = {}
    for name in ("a", "b", "c"):
        lines[name] = ["x" * rng.randrange(200) + str(k) for k in range(3_000 if name != "c" else 1)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines[name]) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        found = G.numbered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 10
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {(r.file.rsplit("/", 1)[1][0], r.line): r.value for r in rows}
    assert len(rows) == 6_001 and got == {(n, k): v for n, vs in lines.items() for k, v in enumerate(vs, 1)}


def runs(spark, rows, kind="v string"):
    return spark.createDataFrame(rows, f"run_id string, {kind}")


def test_a_run_is_replaced_in_one_step(spark, tmp_path):
    folder = str(tmp_path / "runs")
    tables = lambda v, *ids, later=None: {"run": runs(spark, [(i, later if i == "r2" else None, v) for i in ids], "supersedes_run_id string, v string"), "events": runs(spark, [(i, f"{v}{k}") for i in ids for k in range(2)]), "qa": runs(spark, []).filter("false")}
    state = lambda: sorted(map(tuple, G.read_runs(spark, folder, "events").collect()))
    G.replace_run(tables("a", "r1", "r2"), folder)
    first = [("r1", "a0"), ("r1", "a1"), ("r2", "a0"), ("r2", "a1")]
    assert state() == first and G.read_runs(spark, folder, "qa").count() == 0
    G.stage_run(tables("lost", "r1"), folder, "lost")  # a writer that dies before its commit
    assert state() == first and sorted(r.v for r in G.read_runs(spark, folder, "run").collect()) == ["a", "a"]
    G.replace_run({**tables("b", "r1"), "events": runs(spark, []).filter("false")}, folder)
    assert state() == [("r2", "a0"), ("r2", "a1")] and sorted((r.run_id, r.v) for r in G.read_runs(spark, folder, "run").collect()) == [("r1", "b"), ("r2", "a")]
    with pytest.raises(ValueError, match="another run"):
        G.replace_run({**tables("c", "r1"), "events": runs(spark, [("r9", "x")])}, folder)
    G.replace_run(tables("d", "r2", later="r1"), folder)
    with pytest.raises(ValueError, match="supersedes"):
        G.replace_run(tables("e", "r1"), folder)
    with pytest.raises(commits.Conflict):
        commits.publish(spark, folder, {}, after=1)
    before = state()
    G.vacuum_runs(spark, folder, ["run", "events", "qa", "switches"])
    assert state() == before and not [n for n in commits.folders(spark, f"{folder}/events") if "lost" in n]


def test_query_rows_of_bundles(spark):
    manifest = '{"mission_id":"m","profile":"fast","schema_version":"2","coordinate_frame":{"name":"w","metric_scale":"metric","calibration_id":null},"degradations":[{"stage":"depth"}],"supersedes_sha256":"sha256:abc"}'
    manifests = spark.createDataFrame([("m", manifest, "a/m")], "mission_id string, manifest string, artifact_dir string")
    events = spark.createDataFrame([("m", "e1", ["x", "y"]), ("m", "e2", None), ("other", "e3", [])], "mission_id string, event_id string, evidence array<string>")
    rest = spark.createDataFrame([("m", "q")], "mission_id string, id string")
    found = G.run_tables(manifests, events, rest, rest)
    run = found["run"].first()
    assert run.run_id == __import__("hashlib").sha256(manifest.encode()).hexdigest() and run.manifest_sha256 == "sha256:" + run.run_id
    assert (run.profile, run.coordinate_frame, run.calibration_id, run.supersedes_run_id, run.degradations) == ("fast", "w", None, "abc", '[{"stage":"depth"}]')
    assert sorted((r.event_id, r.evidence_count, r.run_id == run.run_id) for r in found["events"].collect()) == [("e1", 2, True), ("e2", 0, True)]
    assert found["qa"].first().artifact_ref == "qa.jsonl"
