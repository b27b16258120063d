"""Sensor streams: ingest, normalisation, pose fusion, camera events, incidents.

All functions take a streaming or a batch DataFrame unless they say otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.commits import committed, publish
from ..sources.storage import materialise, release

#: Share of the interval that two caption frames are apart at least.
LEAST_SHARE = 0.8
SENSORS = ("camera", "gps", "imu", "barometer", "magnetometer")


def ingest_packets(raw: DataFrame, allowed: Sequence[str] = SENSORS) -> tuple[DataFrame, DataFrame]:
    """(packets, dead letters with a reason): sensor in lower case and known, a device time, a payload."""
    rows = raw.withColumn("sensor_type", F.lower(F.trim("sensor_type")))
    reason = F.coalesce(
        F.when(F.col("t_device").isNull(), F.lit("no_time")), F.when(~F.coalesce(F.col("sensor_type").isin(list(allowed)), F.lit(False)), F.lit("unknown_sensor")), F.when(F.try_parse_json("payload").isNull(), F.lit("bad_payload"))
    )
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def ingest_semantics(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, dead letters): a class in lower case and a confidence in [0, 1]."""
    rows = raw.withColumn("class_name", F.nullif(F.lower(F.trim("class_name")), F.lit("")))
    ok = F.coalesce(F.col("class_name").isNotNull() & F.col("confidence").between(0.0, 1.0), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def epoch_seconds(t: Column) -> Column:
    """Seconds of a device time in microseconds (above 1e12), milliseconds (above 1e9) or seconds."""
    return F.when(t > 1e12, t / 1e6).when(t > 1e9, t / 1e3).otherwise(t.cast("double"))


def normalise_telemetry(raw: DataFrame) -> DataFrame:
    """MAVLink-style messages (message_type, timestamp, payload JSON) to packets in SI units.

    Degrees beyond 180 are 1e7 integers, heights beyond 1,000 millimetres, speeds
    of positions cm/s; the height above ground goes before the one above sea.
    Messages of other kinds, without a time, or of a compass without a heading
    give no packet.
    """
    number = lambda path: F.expr(f"try_cast(get_json_object(payload, '$.{path}') AS DOUBLE)")
    kind = F.upper(F.trim("message_type"))
    position, inertial, pressure = kind.isin("GLOBAL_POSITION_INT", "GPS_RAW_INT"), kind.isin("ATTITUDE", "HIGHRES_IMU", "RAW_IMU"), kind.isin("SCALED_PRESSURE", "ALTITUDE")
    compass = kind.isin("VFR_HUD", "COMPASSMOT_STATUS") & number("heading").isNotNull()
    sensor = F.when(position, "gps").when(inertial, "imu").when(pressure, "barometer").when(compass, "magnetometer")
    scaled = lambda x, most, by: F.when(F.abs(x) > most, x / by).otherwise(x)
    height = F.when(position, scaled(F.coalesce(number("relative_alt"), number("alt")), 1000, 1e3)).when(pressure, F.coalesce(number("altitude"), number("press_abs")))
    of = lambda group, *paths: [F.when(group, number(path)).alias(path) for path in paths]
    return raw.select(
        "packet_id", "session_id", sensor.alias("sensor_type"), epoch_seconds(F.col("timestamp")).alias("t_device"), *[F.when(position, scaled(number(c), 180, 1e7)).alias(c) for c in ("lat", "lon")],
        height.alias("altitude"), *of(position, "east", "north", "up"), *[F.when(position, number(c) / 100).alias(c) for c in ("vx", "vy", "vz")], *of(inertial, "roll", "pitch", "yaw", "rollspeed", "pitchspeed", "yawspeed", "xacc", "yacc", "zacc"),
        F.when(compass, number("heading")).alias("heading"),
    ).filter("sensor_type is not null and t_device is not null")


def topic_sensor(topic: Column) -> Column:
    """Sensor of a ROS-style topic, by its end."""
    ends = {"imu": ("/imu",), "gps": ("/gps", "/fix"), "barometer": ("/barometer", "/pressure"), "magnetometer": ("/mag", "/magnetometer"), "camera": ("/image", "/camera/image_raw")}
    return F.coalesce(*[F.when(F.trim(topic).endswith(end), F.lit(sensor)) for sensor, all_ends in ends.items() for end in all_ends])


def normalise_topics(raw: DataFrame) -> DataFrame:
    """ROS-style messages (topic, stamp, payload) to packets; a message without a stamp is at 0, other topics give none."""
    return raw.select("packet_id", "session_id", topic_sensor(F.col("topic")).alias("sensor_type"), F.coalesce("stamp", F.lit(0.0)).alias("t_device"), "payload").filter("sensor_type is not null")


# What fusion reads of a payload; numbers may come as text.
XYZW, XYZ = "struct<x:string,y:string,z:string,w:string>", "struct<x:string,y:string,z:string>"
READING = ", ".join(f"{c} string" for c in ("east", "north", "up", "altitude", "vx", "vy", "vz", "ve", "vn", "vu", "roll", "pitch", "yaw", "heading", "global_map_id")) + f", orientation_quat {XYZW}, velocity_enu {XYZ}"
FUSED = ("gps", "imu", "barometer", "magnetometer")


def euler_quaternion(roll: Column, pitch: Column, yaw: Column) -> Column:
    """(x, y, z, w) of Euler angles in radians."""
    (sr, cr), (sp, cp), (sy, cy) = ((F.sin(a / 2), F.cos(a / 2)) for a in (roll, pitch, yaw))
    return F.struct((sr * cp * cy - cr * sp * sy).alias("x"), (cr * sp * cy + sr * cp * sy).alias("y"), (cr * cp * sy - sr * sp * cy).alias("z"), (cr * cp * cy + sr * sp * sy).alias("w"))


def fuse_pose(packets: DataFrame, max_lag_ms: float, window: str | None = None) -> DataFrame:
    """One row for each session (and event-time window), fused from the latest packet of each sensor.

    Sensors that give a reading (gps a place, imu a turn or a velocity, barometer
    a height, magnetometer a heading) decide: the newest is the anchor, and those
    further back than the lag are dropped.  A pose needs gps; without it all but
    the keys is null.  Height comes from the barometer if there is one,
    orientation from the imu, else the magnetometer, velocity from the imu, else
    gps.  The trace of the covariance falls with the number of sensors, to four,
    and grows by the seconds that they are behind the anchor.
    """
    keys = ["session_id"] + ([F.window("ts", window).alias("window")] if window else [])
    names = ["session_id"] + (["window"] if window else [])
    rows = packets.withColumn("r", F.from_json("payload", READING))
    newest = lambda s: F.max_by(F.struct("t_device", "packet_id", "r"), F.when(F.col("sensor_type") == s, F.struct("t_device", "packet_id"))).alias(s)
    rows = rows.groupBy(*keys).agg(*[newest(s) for s in FUSED])
    number = lambda path: F.expr(f"try_cast({path} AS DOUBLE)")
    vector = lambda prefix, x, y, z: F.when(number(f"{prefix}.{x}").isNotNull() & number(f"{prefix}.{y}").isNotNull(), F.struct(number(f"{prefix}.{x}").alias("x"), number(f"{prefix}.{y}").alias("y"), F.coalesce(number(f"{prefix}.{z}"), F.lit(0.0)).alias("z")))
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    quat = [number(f"imu.r.orientation_quat.{c}") for c in "xyzw"]
    given = F.when(F.expr(" AND ".join(f"try_cast(imu.r.orientation_quat.{c} AS DOUBLE) IS NOT NULL" for c in "xyzw")), F.struct(*[q.alias(c) for q, c in zip(quat, "xyzw")]))
    turned = F.when(number("imu.r.yaw").isNotNull(), euler_quaternion(zero("imu.r.roll"), zero("imu.r.pitch"), number("imu.r.yaw")))
    heading = F.coalesce(number("magnetometer.r.heading"), number("magnetometer.r.yaw"))
    rows = rows.select(
        *names, *FUSED, F.coalesce(vector("gps.r", "vx", "vy", "vz"), vector("gps.r", "ve", "vn", "vu")).alias("gps_v"), F.coalesce(given, turned).alias("imu_q"), F.coalesce(vector("imu.r.velocity_enu", *"xyz"), vector("imu.r", "vx", "vy", "vz")).alias("imu_v"),
        F.coalesce(number("barometer.r.altitude"), number("barometer.r.up")).alias("height"), F.when(heading.isNotNull(), euler_quaternion(F.lit(0.0), F.lit(0.0), heading)).alias("magnetometer_q"),
    )
    usable = {"gps": number("gps.r.east").isNotNull() & number("gps.r.north").isNotNull(), "imu": F.col("imu_q").isNotNull() | F.col("imu_v").isNotNull(), "barometer": F.col("height").isNotNull(), "magnetometer": F.col("magnetometer_q").isNotNull()}
    rows = rows.withColumn("anchor", F.greatest(*[F.when(usable[s], F.col(f"{s}.t_device")) for s in FUSED]))
    behind = {s: (F.col("anchor") - F.col(f"{s}.t_device")) * 1000.0 for s in FUSED}
    fresh = {s: F.coalesce(usable[s] & (behind[s] <= max_lag_ms), F.lit(False)) for s in FUSED}
    rows = rows.select("*", *[fresh[s].alias(f"{s}_on") for s in FUSED])
    on = {s: F.col(f"{s}_on") for s in FUSED}
    orientation = F.coalesce(F.when(on["imu"], F.col("imu_q")), F.when(on["magnetometer"], F.col("magnetometer_q")))
    used = F.filter(F.array(F.lit("gps"), F.when(on["imu"], "imu"), F.when(on["barometer"], "barometer"), F.when(on["magnetometer"] & ~on["imu"], "magnetometer")), lambda x: x.isNotNull())
    lag = sum((F.when(on[s], F.bround(behind[s], 0)).otherwise(0.0) for s in FUSED), F.lit(0.0)) / 1000.0
    trace = F.round(F.greatest(F.lit(0.05), F.lit(1.0) - F.least(F.size(used), F.lit(4)) * 0.18) + lag, 4)
    position = F.struct(number("gps.r.east").alias("x"), number("gps.r.north").alias("y"), F.coalesce(F.when(on["barometer"], F.col("height")), number("gps.r.up"), number("gps.r.altitude"), F.lit(0.0)).alias("z"))
    map_id = F.coalesce(*[F.when(on[s], F.expr(f"try_cast({s}.r.global_map_id AS BIGINT)")) for s in FUSED])
    pose = {
        "gps_packet": F.col("gps.packet_id"), "t_sec": F.col("anchor"), "source": F.when(F.size(used) == 1, F.lit("gps_fallback")).otherwise(F.concat_ws("_", F.lit("fused"), used)), "position_enu": position, "orientation_quat": orientation,
        "velocity_enu": F.coalesce(F.when(on["imu"], F.col("imu_v")), F.col("gps_v")), "covariance_trace": trace, "tracking_status": F.when(F.size(used) == 1, "degraded").otherwise("ok"), "global_map_id": map_id,
    }
    return rows.select(*names, *[F.when(on["gps"], c).alias(k) for k, c in pose.items()])


def carry_pose(poses: DataFrame) -> DataFrame:
    """Batch: windows without a pose take the last one of their session, as it was; before the first there is none."""
    order = Window.partitionBy("session_id").orderBy("window").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [c for c in poses.columns if c not in ("session_id", "window")]
    last = F.last(F.when(F.col("source").isNotNull(), F.struct(*columns)), ignorenulls=True).over(order)
    return poses.select("session_id", "window", F.col("source").isNull().alias("carried"), last.alias("pose")).select("session_id", "window", "carried", "pose.*")


def camera_events(raw: DataFrame) -> DataFrame:
    """Camera messages (value JSON) to events: the nested ``after``, tolerant numbers, a region only if it is a map."""
    at = lambda path: F.get_json_object("value", f"$.after.{path}")
    number = lambda path: F.expr(f"try_cast(get_json_object(value, '$.after.{path}') as double)")
    region = F.when(at("region").startswith("{"), F.from_json(at("region"), "map<string,double>"))
    return raw.select(
        at("id").alias("event_id"), at("camera").alias("camera"), at("label").alias("label"), F.coalesce(number("score"), F.lit(0.0)).alias("score"), F.coalesce(number("top_score"), number("score"), F.lit(0.0)).alias("top_score"),
        F.get_json_object("value", "$.type").alias("event_type"), number("start_time").alias("started_at"), number("end_time").alias("ended_at"), F.coalesce(at("has_clip") == "true", F.lit(False)).alias("has_clip"), region.alias("region"),
    ).filter("event_id is not null and camera is not null")


def freshness(events: DataFrame, event_time: str = "event_time", ingest_time: str = "ingest_time") -> DataFrame:
    """Seconds between event and ingest; node and sensor in lower case."""
    seconds = F.timestamp_diff("MILLISECOND", F.col(event_time), F.col(ingest_time)) / 1000.0
    return events.withColumn("freshness_sec", seconds).withColumn("node_id", F.lower(F.trim("node_id"))).withColumn("sensor_type", F.lower(F.trim("sensor_type")))


def matched(envelopes: DataFrame, rules: DataFrame) -> DataFrame:
    """Envelopes (ts, zone_id, modality, confidence) with each enabled rule that names their modality and zone."""
    named = rules.filter("enabled").select("rule_id", "modalities", F.col("zone_id").alias("rule_zone"), "window_s", "min_confidence", F.explode(F.array_distinct("modalities")).alias("rule_modality"))
    met = envelopes.join(named, (F.col("modality") == F.col("rule_modality")) & (F.col("rule_zone").isNull() | (F.col("rule_zone") == F.col("zone_id"))) & (F.col("confidence") >= F.col("min_confidence")))
    return met.select("rule_id", "zone_id", "modalities", F.col("window_s").cast("long").alias("window_s"), "ts", "modality", "confidence")


#: Lengths of a rule's window in a chunk of time; a chunk is one task's share of a zone.
CHUNK_WINDOWS = 64


def incidents(envelopes: DataFrame, rules: DataFrame) -> DataFrame:
    """Batch: times at which a rule's modalities have all occurred in one zone within its window.

    ``rules`` has (rule_id, modalities, zone_id or null for any, window_s,
    min_confidence, enabled).  The window slides: it ends at each event of a
    rule and a zone.  Events in a row that complete it are one incident, told at
    the first; an event more than a window later begins another one.  Each chunk
    of time is worked out by itself, with the two windows before it.
    """
    keys = ["rule_id", "zone_id"]
    met = matched(envelopes, rules).withColumn("at", F.unix_micros("ts")).withColumn("window_us", F.col("window_s") * 1_000_000)
    stamps = met.groupBy(*keys, "at", "window_us", "modalities").agg(F.collect_set("modality").alias("seen"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    length = F.col("window_us") * CHUNK_WINDOWS
    own, late = F.floor(F.col("at") / length), F.col("at") % length >= length - 2 * F.col("window_us")
    chunk = F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    dealt = stamps.withColumn("own", own).withColumn("chunk", chunk)
    each = dealt.withColumn("wanted", F.explode(F.array_distinct("modalities")))
    order = Window.partitionBy(*keys, "chunk", "wanted").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("last", F.coalesce(F.max(F.when(F.expr("array_contains(seen, wanted)"), F.col("at"))).over(order), F.lit(-(1 << 62))))
    told = each.groupBy(*keys, "chunk", "own", "at", "window_us", "confidence", "n").agg(F.min("last").alias("oldest"), F.array_sort(F.collect_set("wanted")).alias("seen"))
    told = told.withColumn("complete", F.col("oldest") >= F.col("at") - F.col("window_us"))
    before = Window.partitionBy(*keys, "chunk").orderBy("at")
    told = told.withColumn("goes_on", F.coalesce(F.lag("complete").over(before) & (F.col("at") - F.lag("at").over(before) <= F.col("window_us")), F.lit(False)))
    return told.filter("complete and not goes_on and chunk = own").select(*keys, F.timestamp_micros("at").alias("at"), "seen", "confidence", "n")


def incidents_stream(envelopes: DataFrame, rules: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """Stream: the incidents of :func:`incidents`, (rule_id, zone_id, at, seen).

    The state of a rule and a zone is the last time of each modality and of the
    last event; it goes when the watermark is a window past it.  Events of a key
    must not come later than a micro-batch; inside one they are sorted.
    """

    def follow(key, batches, state: GroupState):
        rule, zone = key
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        times, last, complete = ({}, None, False)
        if state.exists:
            names, stamps, last, complete = state.get
            times = dict(zip(names, stamps))
        out = []
        for at, group in rows.groupby("at", sort=True):
            at, wanted, window = int(at), sorted(set(group["modalities"].iloc[0])), int(group["window_s"].iloc[0]) * 1_000_000
            times |= dict.fromkeys(group["modality"], at)
            goes_on = complete and at - last <= window
            complete = all(m in times and times[m] >= at - window for m in wanted)
            if complete and not goes_on:
                out.append((rule, zone, at, wanted))
            last = at
        state.update((list(times), list(times.values()), last, complete))
        state.setTimeoutTimestamp(max(last // 1000 + int(rows["window_s"].iloc[0]) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["rule_id", "zone_id", "at", "seen"])

    rows = matched(envelopes.withWatermark("ts", watermark), rules).withColumn("at", F.unix_micros("ts"))
    schema = "rule_id string, zone_id string, at long, seen array<string>"
    found = rows.groupBy("rule_id", "zone_id").applyInPandasWithState(follow, schema, "names array<string>, stamps array<long>, last long, complete boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("at", F.timestamp_micros("at"))


def spaced(rows: DataFrame, keys: Sequence[str], spacing_sec: float) -> DataFrame:
    """Rows such that each follows the one taken before it by the spacing at least; the first of a key is taken.

    Which row follows is known for every row at once, as its first one that is far
    enough.  The chain from the first row is then found by doubling: in each round
    what is reached jumps on by as many rows as it has, and every jump becomes two.
    """
    from ..operators.joins import asof

    at = Window.partitionBy(*keys).orderBy("t_sec", "frame_id")
    numbered = materialise(rows.select(*keys, "t_sec", "frame_id").withColumn("nth", F.row_number().over(at)), "spaced-rows")
    # The first row at or after a time is the last one at or before it on the clock turned round.
    turned = numbered.groupBy(*keys, "t_sec").agg(F.min("nth").alias("to")).withColumn("t_sec", -F.col("t_sec"))
    asks = numbered.select(*keys, F.col("nth").alias("query_id"), (-(F.col("t_sec") + spacing_sec)).alias("t_sec"))
    jumps = materialise(asof(asks, turned, keys, ["to"], tolerance=0.0).filter("to is not null").select(*keys, F.col("query_id").alias("nth"), "to"), "spaced-jumps")
    reached = materialise(numbered.filter("nth = 1").select(*keys, "nth"), "spaced-reached")
    while not jumps.isEmpty():
        far = jumps.withColumnRenamed("nth", "via").withColumnRenamed("to", "beyond")
        old_jumps, old_reached = jumps, reached
        reached = materialise(reached.unionByName(reached.join(jumps, [*keys, "nth"]).select(*keys, F.col("to").alias("nth"))), "spaced-reached")
        jumps = materialise(jumps.join(far.withColumnRenamed("via", "to"), [*keys, "to"]).select(*keys, "nth", F.col("beyond").alias("to")), "spaced-jumps")
        release(old_jumps, old_reached)
    return numbered.join(reached, [*keys, "nth"], "left_semi").select(*keys, "t_sec", "frame_id")


def rate_limit(rows: DataFrame, keys: Sequence[str], every: int, interval_sec: float) -> DataFrame:
    """Batch: every so-manieth row, and of these none nearer than 0.8 of the interval to the one taken before it."""
    order = Window.partitionBy(*keys).orderBy("t_sec", "frame_id")
    nth = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") % every == 0)
    return spaced(nth, keys, LEAST_SHARE * interval_sec)


class RateProcessor(StatefulProcessor):
    """The row limit with the number of rows and the time of the last one taken as state."""

    def __init__(self, every: int, spacing_sec: float, names: list[str]):
        self.every, self.spacing_sec, self.names = every, spacing_sec, names

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", "place long, t_sec double")

    def handleInputRows(self, key, rows, timerValues):
        place, last = self.state.get() if self.state.exists() else (0, None)
        taken = []
        for t, frame in pd.concat(list(rows)).sort_values(["t_sec", "frame_id"])[["t_sec", "frame_id"]].itertuples(index=False, name=None):
            place += 1
            if place % self.every == 0 and (last is None or t >= last + self.spacing_sec):
                last = t
                taken.append((*key, t, frame))
        self.state.update((place, last))
        yield pd.DataFrame(taken, columns=self.names)

    def close(self) -> None:
        pass


def rate_limit_stream(rows: DataFrame, keys: Sequence[str], every: int, interval_sec: float) -> DataFrame:
    """Stream: :func:`rate_limit`; rows of a key must arrive in order, inside a batch they are sorted.

    Needs the RocksDB state store.
    """
    kept = rows.select(*keys, "t_sec", "frame_id")
    return kept.groupBy(*keys).transformWithStateInPandas(RateProcessor(every, LEAST_SHARE * interval_sec, kept.columns), kept.schema, "append", "none")


def acoustic_to_events(observations: DataFrame) -> DataFrame:
    """One event row for each sound of an observation that isn't silent."""
    return observations.filter("not silence").select("camera", "recorded_at", F.explode("acoustic_events").alias("e")).select("camera", F.col("e.event").alias("label"), F.col("e.energy_ratio").alias("score"), F.col("recorded_at").alias("started_at"))


def degraded(health: DataFrame, window: str, stale_sec: float) -> DataFrame:
    """Advisories by sector and window: outages and stale inputs lower the confidence."""
    rows = health.groupBy("sector_id", F.window("ts", window).alias("window")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "down").alias("down"), F.count_if(F.col("freshness_sec") > stale_sec).alias("stale")
    )
    bad = (F.col("down") + F.col("stale")) / F.col("n")
    return rows.select("sector_id", F.col("window.start").alias("window_start"), "n", "down", "stale", F.round(F.greatest(F.lit(0.0), F.lit(1.0) - bad), 6).alias("confidence"), (bad > 0).alias("degraded"))


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row of each key: a batch result, or a stream in update mode."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def upsert_latest(root: str, keys: Sequence[str], order: Sequence[str]):
    """A ``foreachBatch`` function that keeps the latest row of each key in a table below ``root``.

    A batch's result is written beside the table and published with the batch's
    number in one step; a batch that comes again, after a restart, changes
    nothing.  :func:`latest_table` reads what was published last.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = committed(spark, root)
        if last is not None and last["batch"] >= number:
            return
        rows = batch if last is None else spark.read.schema(batch.schema).parquet(last["path"]).unionByName(batch)
        path = f"{root}/data/batch-{number}-{uuid.uuid4().hex}"
        latest_rows(rows, keys, order).select(*batch.columns).write.parquet(path)
        publish(spark, root, {"batch": number, "path": path})

    return upsert


def latest_table(spark, root: str) -> DataFrame | None:
    """The table that :func:`upsert_latest` published last."""
    last = committed(spark, root)
    return None if last is None else spark.read.parquet(last["path"])


def finalise(frames: DataFrame, packets: DataFrame) -> DataFrame:
    """Sessions to missions: frames, and the larger of camera packets and frames."""
    f = frames.groupBy("session_id").agg(F.count("*").alias("frames"), F.max("t_sec").alias("last_t"))
    p = packets.groupBy(F.col("session_id").alias("p_session")).agg(F.count_if(F.col("sensor_type") == "camera").alias("camera_packets"))
    return f.join(p, F.col("session_id") == F.col("p_session"), "left").select("session_id", "frames", "last_t", F.greatest("frames", F.coalesce("camera_packets", F.lit(0))).alias("frame_count"))


def route(messages: DataFrame, contracts: dict[str, tuple[str, str, Sequence[str]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Messages (topic, value) by topic pattern to contracts, and a dead-letter table.

    A contract is (topic pattern, schema, required fields); the first pattern
    that matches counts.
    """
    name = F.coalesce(*[F.when(F.col("topic").rlike(pattern), F.lit(k)) for k, (pattern, _, _) in contracts.items()])
    rows = messages.withColumn("contract", name)
    good, dead = {}, rows.filter("contract is null").select("topic", "value", F.lit("no_contract").alias("reason"))
    for k, (_, schema, required) in contracts.items():
        own = rows.filter(F.col("contract") == k).withColumn("row", F.from_json("value", schema))
        ok = F.col("row").isNotNull()
        for field in required:
            ok = ok & F.col(f"row.{field}").isNotNull()
        ok = F.coalesce(ok, F.lit(False))
        good[k] = own.filter(ok).select("topic", "row.*")
        dead = dead.unionByName(own.filter(~ok).select("topic", "value", F.lit("invalid").alias("reason")))
    return good, dead


def append_timeline(captions: DataFrame, path: str, checkpoint: str):
    """Starts the stream that appends captions to the scene timeline; returns its query."""
    rows = captions.filter("caption is not null").select("mission_id", "frame_id", "t_sec", "caption")
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
