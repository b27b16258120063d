"""Steps whose work must not outgrow their input."""

from __future__ import annotations

from missionspark.operators import cloud, logs


def test_cycles_stop_when_nothing_is_dropped(spark, monkeypatch):
    tail = [(k, k + 1) for k in range(10, 40)] + [(40, 2)]  # leads into a cycle of three
    ring = [(1, 2), (2, 3), (3, 1), (7, 7)]
    ends = [(k, k + 1) for k in range(100, 2000)]
    rounds = []
    real = logs.materialise
    monkeypatch.setattr(logs, "materialise", lambda df, name: rounds.append(name) or real(df, name))
    pairs = spark.createDataFrame(ring + tail, "child long, parent long")
    assert sorted(r.node for r in logs.check_cycles(pairs).collect()) == [1, 2, 3, 7]
    rounds.clear()
    many = spark.createDataFrame(ring + [(k, k % 2 + 1) for k in range(10_000, 12_000)], "child long, parent long")
    assert sorted(r.node for r in logs.check_cycles(many).collect()) == [1, 2, 3, 7]
    assert len(rounds) <= 4  # eleven or more before
    assert logs.check_cycles(spark.createDataFrame(ends[:40], "child long, parent long")).isEmpty()


def test_boxes_of_clouds_cut_by_batches(spark):
    rows = [(k % 3, 0.0, float(k * 7 % 11), float(k * 5 % 13), float(k % 4)) for k in range(90)]
    points = spark.createDataFrame(rows, "track_id long, t_sec double, x double, y double, z double")
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    box = lambda df: sorted(tuple(r)[:10] for r in df.collect())  # noqa: E731  the spread behind them has sums in any order
    whole = box(cloud.box_fit(points))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        fit = cloud.box_fit(points)
        assert box(fit) == whole and [r[9] for r in whole] == [30, 30, 30]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
    assert "Generate explode" not in fit._jdf.queryExecution().toString()  # no row a point and yaw
