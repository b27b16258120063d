"""Streams give what their batches give."""

from __future__ import annotations

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from missionspark.plans.registry import Tables
from missionspark.plans.streams import _readings
from missionspark.streaming import packets as T
from missionspark.streaming import selection as S


def through(spark, batch, f, mode, tmp_path, files=3):
    """Runs ``f`` over a batch's rows as a stream of some files, in order."""
    source = str(tmp_path / "in")
    batch.repartitionByRange(files, batch.columns[0]).write.parquet(source)
    for k, path in enumerate(sorted((tmp_path / "in").glob("part-*"))):  # files are read in order of time
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def as_set(df):
    return sorted(map(str, df.collect()))


def test_ingest_stream_is_the_batch(spark, sf_dir, tmp_path):
    rows = Tables(spark, sf_dir)("packets").select("packet_id", "session_id", "sensor_type", "t_device", "payload")
    ok = lambda df: T.ingest_packets(df)[0]
    assert as_set(through(spark, rows, ok, "append", tmp_path)) == as_set(ok(rows))


def test_pose_stream_ends_as_the_batch(spark, sf_dir, tmp_path):
    rows = _readings(Tables(spark, sf_dir)).select("packet_id", "session_id", "sensor_type", "t_device", "payload")
    fuse = lambda df: T.fuse_pose(df, 4e7)
    assert as_set(through(spark, rows, fuse, "complete", tmp_path)) == as_set(fuse(rows))


@pytest.fixture
def state_store(spark):
    key, value = next(iter(S.STATE_STORE.items()))
    was = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, was)


FRAMES = "frame_id long, mission_id long, t_sec double, thumb array<double>, vector array<double>, good boolean"


def looks(n=240):
    rng = random.Random(7)
    rows, scene = [], {0: 0, 1: 0}
    for i in range(n):
        m = i % 2
        scene[m] = rng.randrange(6) if rng.random() < 0.3 else scene[m]
        thumb = [float((scene[m] * 41 + 13 * k * (1 + scene[m] % 3)) % 256) for k in range(16)]
        rows.append((i, m, i * 0.5, thumb, [math.cos(scene[m] / 4), math.sin(scene[m] / 4)], rng.random() < 0.9))
    return rows


def test_kept_frame_stream_is_the_batch(spark, tmp_path, state_store):
    rows = spark.createDataFrame(looks(), FRAMES)
    gate = S.KeepGate(change=0.5, most_gap=15.0)
    batch = S.keep_frames(rows, gate)
    assert 20 < batch.count() < 200 and batch.select("rate").distinct().count() > 3
    assert as_set(through(spark, rows, lambda df: S.keep_frames_stream(df, gate), "append", tmp_path)) == as_set(batch)


def test_rate_of_reading_follows_the_motion():
    gate = S.KeepGate()
    read = []
    for thumbs in ([[100.0] * 4] * 40, [[37.0 * i % 256] * 4 for i in range(16)]):
        state, at = gate.start(), []
        for i, thumb in enumerate(thumbs):
            before = state["wait"]
            S.look_at(state, gate, float(i), thumb, [1.0, 0.0], True)
            if before == 0:
                at.append(i)
        read.append(at)
    # The step of the frame before counts: 2 first, then 5 (rate 1) and 10 (rate 0.5).
    assert read[0] == [0, 2, 7, 17, 27, 37]
    assert read[1] == [0, 2, 7, 10, 12, 13, 14, 15]  # rates 1, 1.5, 2.25, 3.375 and 5


def test_thresholds_are_strict():
    gate = S.KeepGate(change=2.0, drift=0.5, most_gap=3.0, still=0.0, rate=5.0)
    state = gate.start()
    kept = [S.look_at(state, gate, t, [1.0, 2.0], v, True) is not None for t, v in ((0.0, [1.0, 0.0]), (1.0, [0.5, 0.5]), (3.0, [1.0, 0.0]), (3.5, [0.25, 0.0]), (6.5, [0.25, 0.0]), (6.75, [0.25, 0.0]))]
    assert kept == [True, False, False, True, True, True]  # the last ones drift from a vector that isn't of unit length


def test_no_two_frames_nearer_than_the_spacing(spark, tmp_path, state_store):
    rng = random.Random(3)
    rows = [(i, i % 3, round(rng.random() * 30, 2)) for i in range(400)]
    rows += [(1000, 9, 0.0), (1001, 9, 0.95), (1002, 9, 1.0), (1003, 9, 1.75), (1004, 9, 1.8), (1005, 9, 1.8)]
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    rows = [(k, m, t) for k, (_, m, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "frame_id long, camera long, t_sec double")
    for every, interval in ((1, 1.25), (3, 1.0)):
        want = []
        for camera in (0, 1, 2, 9):
            last = None
            for place, (t, frame) in enumerate(sorted((t, f) for f, c, t in rows if c == camera), 1):
                if place % every == 0 and (last is None or t >= last + 0.8 * interval):
                    last = t
                    want.append((camera, t, frame))
        got = T.rate_limit(df, ["camera"], every, interval)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [t for c, t, _ in map(tuple, T.rate_limit(df, ["camera"], 1, 1.25).orderBy("t_sec").collect()) if c == 9] == [0.0, 1.0]
    assert as_set(through(spark, df, lambda d: T.rate_limit_stream(d, ["camera"], 3, 1.0), "append", tmp_path)) == as_set(T.rate_limit(df, ["camera"], 3, 1.0))
    assert T.rate_limit(df.filter("false"), ["camera"], 1, 1.0).count() == 0


def test_tracks_end_although_no_frame_comes(spark, tmp_path, state_store):
    mine = [("a", 1, 0.0), ("b", 1, 0.5)]
    others = [(f"o{k}", 2, 0.5 * k) for k in range(14)]
    rows = spark.createDataFrame([(t, m, d, "car", 0.1, 0.1, 0.2, 0.2, False, None) for d, m, t in sorted(mine + others, key=lambda r: r[2])], "t_sec double, mission_id long, detection_id string, label string, x double, y double, w double, h double, cut boolean, descriptor array<double>")
    got = through(spark, rows, S.track_stream, "append", tmp_path, files=7).filter("mission_id = 1").collect()
    assert [(r.track_id, r.state, round(r.t_sec, 2)) for r in sorted(got, key=lambda r: r.t_sec)] == [("track-0001", "tentative", 0.0), ("track-0001", "confirmed", 0.5), ("track-0001", "lost", 1.5), ("track-0001", "ended", 2.5)]


def test_latest_tiles_by_upsert(spark, tmp_path):
    root = str(tmp_path / "tiles")
    put = T.upsert_latest(root, ["tile"], ["t_sec", "id"])
    batch = lambda *rows: spark.createDataFrame(rows, "tile string, id long, t_sec double")
    assert T.latest_table(spark, root) is None
    put(batch(("a", 1, 1.0), ("b", 2, 1.0), ("a", 3, 2.0)), 0)
    put(batch(("b", 4, 0.5), ("c", 5, 0.0)), 1)
    want = [("a", 3, 2.0), ("b", 2, 1.0), ("c", 5, 0.0)]
    assert sorted(map(tuple, T.latest_table(spark, root).collect())) == want
    put(batch(("b", 9, 9.0)), 1)  # a batch that comes again
    assert sorted(map(tuple, T.latest_table(spark, root).collect())) == want
    # A batch that was written but never published is seen by nobody.
    batch(("z", 1, 1.0)).write.parquet(f"{root}/data/batch-2-lost")
    assert sorted(map(tuple, T.latest_table(spark, root).collect())) == want
    rows = spark.createDataFrame([(k % 4, k, float(k)) for k in range(40)], "tile long, id long, t_sec double")
    source, name = str(tmp_path / "in"), str(tmp_path / "live")
    rows.repartitionByRange(4, "id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(T.upsert_latest(name, ["tile"], ["t_sec"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.id for r in T.latest_table(spark, name).collect()) == [36, 37, 38, 39]


def test_a_commit_is_refused_after_another(spark, tmp_path):
    from missionspark.sources import commits

    root = str(tmp_path / "c")
    assert commits.publish(spark, root, {"a": 1}, after=0) == 1
    with pytest.raises(commits.Conflict):
        commits.publish(spark, root, {"a": 2}, after=0)
    assert commits.publish(spark, root, {"a": 3}, after=1) == 2 and commits.committed(spark, root) == {"a": 3}


RULES = "rule_id string, modalities array<string>, zone_id string, window_s int, min_confidence double, enabled boolean"


def envelopes(spark, rows):
    return spark.createDataFrame(rows, "s double, zone_id string, modality string, confidence double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))


def test_incidents_slide(spark):
    """One second apart over the edge of a minute is one incident; a minute and a second is none."""
    rows = [(59.5, "z", "audio", 0.9), (60.5, "z", "video", 0.8), (70.0, "z", "audio", 0.9), (200.0, "z", "audio", 0.9), (261.0, "z", "video", 0.9), (262.0, "z", "audio", 0.4), (259.0, "y", "audio", 0.9), (3900.0, "y", "video", 0.9), (3960.0, "y", "audio", 0.9)]
    rules = spark.createDataFrame([("r", ["audio", "video"], None, 60, 0.5, True), ("off", ["audio"], None, 60, 0.5, False), ("y", ["audio"], "y", 60, 0.5, True)], RULES)
    got = sorted((r.rule_id, r.zone_id, r.at.timestamp() % 86400, r.seen) for r in T.incidents(envelopes(spark, rows), rules).collect())
    assert [g[:2] for g in got] == [("r", "y"), ("r", "z"), ("y", "y"), ("y", "y")] and [g[2] % 3600 for g in got] == [360.0, 60.5, 259.0, 360.0] and got[0][3] == ["audio", "video"]


def brute_incidents(rows, wanted, window):
    found = []
    for zone in sorted({r[1] for r in rows}):
        mine = sorted((s, m) for s, z, m, c in rows if z == zone and c >= 0.5 and m in wanted)
        last, full = None, False
        for s in sorted({s for s, _ in mine}):
            now = {m for t, m in mine if s - window <= t <= s} == set(wanted)
            if now and not (full and s - last <= window):
                found.append((zone, s))
            last, full = s, now
    return found


def test_incidents_against_brute_force_in_batch_and_stream(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(T, "CHUNK_WINDOWS", 4)

    rng = random.Random(3)
    rows = [(float(rng.randrange(20_000)) / 2, rng.choice("yz"), rng.choice(["audio", "video", "lora"]), rng.choice([0.4, 0.9])) for _ in range(700)]
    rules = spark.createDataFrame([("r", ["audio", "video", "lora"], None, 120, 0.5, True)], RULES)
    want = brute_incidents(rows, ["audio", "video", "lora"], 120.0)
    at = lambda df: sorted((r.zone_id, r.at_us / 1e6) for r in df.select("zone_id", F.unix_micros("at").alias("at_us")).collect())
    df = envelopes(spark, rows)
    assert len(want) > 20 and at(T.incidents(df, rules)) == want
    stream = through(spark, df, lambda e: T.incidents_stream(e, rules), "append", tmp_path, files=4)
    assert at(stream) == want


def fused(spark, readings, lag_ms):
    rows = [(k, 1, s, t, json.dumps(p)) for k, (s, t, p) in enumerate(readings)]
    return T.fuse_pose(spark.createDataFrame(rows, "packet_id long, session_id long, sensor_type string, t_device double, payload string"), lag_ms).first()


@pytest.mark.parametrize(
    "readings, lag_ms, source, trace, height",
    [
        ([("gps", 12.5, {"east": 1, "north": 2, "up": 3}), ("imu", 12.54, {"yaw": 0.2}), ("barometer", 12.56, {"altitude": 90})], 100, "fused_gps_imu_barometer", 0.54, 90.0),  # 1 - 3 * 0.18, 60 + 20 + 0 ms behind
        ([("gps", 12.5, {"east": 1, "north": 2, "up": 3}), ("imu", 12.54, {"yaw": 0.2}), ("barometer", 12.56, {"altitude": 90})], 30, None, None, None),  # gps is 60 ms behind
        ([("gps", 10.0, {"east": "1", "north": "2", "altitude": 7}), ("imu", 8.0, {"yaw": 0.2})], 1500, "gps_fallback", 0.82, 7.0),
        ([("gps", 10.0, {"east": 1, "north": 2}), ("magnetometer", 10.25, {"heading": 1.0}), ("barometer", 10.0, {"up": 5})], 1000, "fused_gps_barometer_magnetometer", 0.96, 5.0),
        ([("gps", 10.0, {"east": 1, "north": 2}), ("imu", 10.0, {"vx": 1, "vy": 2}), ("magnetometer", 10.5, {"heading": 1.0})], 1000, "fused_gps_imu", 1.64, 0.0),  # the compass turns it but isn't named beside the imu
        ([("gps", 10.0, {"east": 1, "north": 2}), ("camera", 99.0, {}), ("imu", 98.0, {})], 1000, "gps_fallback", 0.82, 0.0),  # neither gives a reading, so neither is the anchor
        ([("gps", 9.0, {"east": 1, "north": 2}), ("gps", 10.0, {"east": 1}), ("imu", 10.0, {"yaw": 1})], 5000, None, None, None),  # the latest gps packet has no place
    ],
)
def test_pose_fusion_golden(spark, readings, lag_ms, source, trace, height):
    row = fused(spark, readings, lag_ms)
    assert row.source == source and (row.covariance_trace is None) == (trace is None)
    if source:
        assert row.covariance_trace == pytest.approx(trace) and row.position_enu.z == height and row.tracking_status == ("degraded" if source == "gps_fallback" else "ok")


def test_pose_orientation_and_velocity(spark):
    row = fused(spark, [("gps", 1.0, {"east": 1, "north": 2, "ve": 3, "vn": 4, "global_map_id": "x"}), ("imu", 1.0, {"orientation_quat": {"x": 0, "y": 0, "z": 1, "w": 0}, "global_map_id": 7}), ("magnetometer", 1.0, {"heading": 2.0})], 10)
    assert tuple(row.orientation_quat) == (0, 0, 1, 0) and tuple(row.velocity_enu) == (3, 4, 0) and row.global_map_id == 7
    row = fused(spark, [("gps", 1.0, {"east": 1, "north": 2}), ("magnetometer", 1.0, {"yaw": 2.0})], 10)
    assert row.orientation_quat.w == pytest.approx(math.cos(1.0)) and row.orientation_quat.z == pytest.approx(math.sin(1.0)) and row.velocity_enu is None


def test_carried_pose(spark):
    gps = json.dumps({"east": 1, "north": 2})
    rows = [(1, 1, "imu", 1.0, "{}", 0), (2, 1, "gps", 2.0, gps, 60), (3, 1, "imu", 3.0, "{}", 120), (4, 2, "imu", 3.0, "{}", 120)]
    df = spark.createDataFrame(rows, "packet_id long, session_id long, sensor_type string, t_device double, payload string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = T.carry_pose(T.fuse_pose(df, 10, "1 minute")).orderBy("session_id", "window").collect()
    assert [(r.session_id, r.carried, r.gps_packet, r.t_sec) for r in out] == [(1, True, None, None), (1, False, 2, 2.0), (1, True, 2, 2.0), (2, True, None, None)]


def thinned(spark, times, capacity, chunk, cuts=()):
    out = S.thin_frames(spark.createDataFrame([(1, i, float(t), i in cuts) for i, t in enumerate(times)], "mission_id long, frame_id long, t_sec double, cut boolean"), capacity, chunk)
    return {r.frame_id: r.gap_end_sec for r in out.collect() if not r.kept}


def test_thinning_drops_the_closest_to_its_forerunner(spark):
    assert thinned(spark, (0, 1, 3, 3.5, 5), 4, 100) == {3: 5.0}
    # One by one: at 1.2 the queue is 0, 1, 1.1, 1.2 and 1.1 goes, though 1.2 will be nearer.
    assert thinned(spark, (0, 1, 1.1, 1.15, 5), 3, 100, cuts=()) == {2: 1.15, 3: 5.0}
    assert thinned(spark, (0, 1, 1.1, 1.2, 5), 3, 100, cuts=(2,)) == {1: 1.1, 3: 5.0}
    assert thinned(spark, (0, 1, 2, 3), 3, 100, cuts=(0, 1, 2, 3)) == {0: 1.0}  # all protected: the oldest
    assert thinned(spark, (0, 1, 2, 3), 3, 100, cuts=(1, 2)) == {0: 1.0}  # else the first that isn't
    assert thinned(spark, (7, 8, 9, 10, 11, 12), 3, 3.0) == {}  # chunks from the first frame


DETECTIONS = "mission_id long, detection_id string, t_sec double, label string, x double, y double, w double, h double, cut boolean, descriptor array<double>"


def tracked(spark, rows, frames=()):
    f = spark.createDataFrame([(1, t, cut) for t, cut in frames], "mission_id long, t_sec double, cut boolean") if frames else None
    out = S.track(spark.createDataFrame([(1, d, t, label, x, 0.1, 0.2, 0.2, False, look) for d, t, label, x, look in rows], DETECTIONS), f)
    return [(r.t_sec, r.track_id, r.state, r.detection_id) for r in out.orderBy("t_sec", "track_id").collect()]


def test_tracker_states(spark):
    rows = [("a", 0.0, "car", 0.1, None), ("b", 0.5, "car", 0.12, None), ("c", 4.0, "car", 0.1, None)]
    got = tracked(spark, rows, [(t, False) for t in (1.0, 1.5, 2.0, 2.5, 3.0)])
    first = [(0.0, "tentative", "a"), (0.5, "confirmed", "b"), (1.0, "occluded", None), (1.5, "occluded", None), (2.0, "lost", None), (3.0, "ended", None)]
    assert got == [(t, "track-0001", s, d) for t, s, d in first] + [(4.0, "track-0002", "tentative", "c")]


def test_tracker_cut_ends_all(spark):
    got = tracked(spark, [("a", 0.0, "car", 0.1, None), ("b", 0.5, "car", 0.1, None), ("c", 0.5, "box", 0.1, None)], [(0.5, True)])
    assert got == [(0.0, "track-0001", "tentative", "a"), (0.5, "track-0001", "ended", None), (0.5, "track-0002", "tentative", "b"), (0.5, "track-0003", "tentative", "c")]


def test_tracker_score():
    box = (0.1, 0.1, 0.2, 0.2)
    assert S.match_score(box, box, 1.0) == pytest.approx(1.0) and S.match_score(box, box) == pytest.approx(0.85)
    assert S.match_score(box, (0.35, 0.1, 0.2, 0.2)) == pytest.approx(0.25 * 0.5 + 0.15)  # half of the reach away
    assert S.likeness([1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.5**0.5) and S.likeness(None, [1.0]) == S.likeness([1.0], [-1.0]) == 0.0
    track = {"box": [0.1, 0.1, 0.2, 0.2], "v": [0.2, 0.0], "t": 1.0}
    assert S.predicted(track, 2.0) == (0.3, 0.1, 0.2, 0.2) and S.predicted(track, 9.0)[0] == 0.8


def test_tracker_stream_is_the_batch(spark, sf_dir, tmp_path, state_store):
    d = Tables(spark, sf_dir)("tracks").filter("mission_id < 12").select("t_sec", "mission_id", F.col("observation_id").alias("detection_id"), "label", "x", "y", "w", "h", (F.col("confidence") < 0.03).alias("cut"), F.array("w", "h").alias("descriptor"))
    batch = S.track(d)
    assert batch.count() > 100
    stream = through(spark, d, S.track_stream, "append", tmp_path, files=4)
    met = lambda df: df.filter("detection_id is not null").select(*[c for c in df.columns if c not in ("t_sec",)], F.round("t_sec", 6).alias("t"))
    assert as_set(met(stream)) == as_set(met(batch))
    # What wasn't met is told by timers, at the end of its span and not at the next frame.
    gone = lambda df: {(r.mission_id, r.track_id) for r in df.filter("state = 'ended'").collect()}
    assert gone(batch) <= gone(stream)


def test_heartbeats_by_definition():
    """One pick after the other, as long as a gap is too long and a free frame is in it."""
    import random

    def by_definition(times, picked, most):
        picked = set(picked)
        while True:
            order = sorted(picked, key=lambda i: (times[i], i))
            for low, high in zip(order, [*order[1:], None]):
                limit = times[low] + most
                if high is not None and times[high] - times[low] <= most:
                    continue
                free = [i for i in range(len(times)) if i not in picked and (times[i] - times[low] > most if high is None else times[low] < times[i] < times[high])]
                free = [i for i in free if times[i] >= limit] or free
                if free:
                    picked.add(min(free, key=lambda i: (abs(times[i] - limit), i)))
                    break
            else:
                return picked

    rng = random.Random(5)
    for _ in range(200):
        times = sorted(rng.sample(range(200), rng.randint(1, 40)))
        picked = sorted({0, *rng.sample(range(len(times)), rng.randint(0, len(times) // 4))})
        assert {*picked, *S.heartbeats([float(t) for t in times], picked, 10.0)} == by_definition(times, picked, 10.0)


def test_keyframe_picks():
    e = [__import__("numpy").array(v, float) for v in ([1, 0, 0], [2, 0, 0], [0, 1, 0], [0.1, 1, 0], [0, 0, 3])]
    assert S.diverse(e, [0], 3) == [2, 4] and S.diverse(e, [0], 9) == [2, 4] and S.diverse(e, [], 2) == [0, 2] and S.diverse(e, [0, 2, 4], 2) == []
    assert S.coalesced([(0.0, False), (0.1, True), (0.2, True), (0.3, False), (0.5, False)], 0.25) == [1, 2, 4]


def test_keyframes_of_a_mission(spark):
    rows = [(1, k, float(k), k != 3, 0.5 if k in (2, 6, 7) else 0.0, k == 5, [float(k == 2), float(k == 6), float(k == 7), 1.0]) for k in range(9)] + [(1, 9, 40.0, True, 0.0, False, None)]
    df = spark.createDataFrame(rows, "mission_id long, frame_id long, t_sec double, good boolean, drift double, cut boolean, embedding array<double>")
    got = lambda **k: {r.frame_id: r.reasons for r in S.keyframes(df, **k).collect()}
    want = {0: ["stream_start"], 2: ["diversity"], 5: ["scene_cut"], 6: ["diversity"], 8: ["max_gap"], 9: ["max_gap"]}  # 8 is the last free frame of a gap that none fills
    assert got(chunk_sec=4.0, budget=2) == want
    assert got(profile="deep", chunk_sec=4.0, budget=1) == {k: v for k, v in want.items()} | {7: ["diversity"]}


def test_silence(spark):
    out = S.acoustic(spark.createDataFrame([(1, [0.0] * 100), (2, [0.5, -0.5] * 50), (3, [])], "chunk_id long, samples array<double>"))
    assert {r.chunk_id: r.silence for r in out.collect()} == {1: True, 2: False, 3: True}
