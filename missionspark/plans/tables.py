"""Queries of filters, aggregates and rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.exprs import degrees_box, half_even
from ..operators import aggregates as A
from ..operators import cells as C
from ..operators import filters as P
from ..operators import ranking as K
from .registry import query

VEHICLES = "coalesce(list_sum(list_transform(json_extract_string(facts, '$.vehicle_groups[*].count'), lambda c: CAST(c AS BIGINT))), 0)"
LAT, LON, RADIUS = 52.02, 13.02, 900.0
LOW, HIGH, WEST, EAST = (repr(x) + ("" if "e" in repr(x) else "e0") for x in degrees_box(LAT, LON, RADIUS))
METRES = f"sqrt(((lat - {LAT}e0) * 111320e0) * ((lat - {LAT}e0) * 111320e0) + ((lon - {LON}e0) * 111320e0 * cos(radians({LAT}e0))) * ((lon - {LON}e0) * 111320e0 * cos(radians({LAT}e0))))"
CURSOR = dt.datetime(2024, 1, 10)


@query("p1_scene_filter", ["frames"], f"""
SELECT frame_id, mission_id, t_sec, json_extract_string(facts, '$.road_condition') AS road_condition, CAST({VEHICLES} AS BIGINT) AS vehicles FROM frames
WHERE facts IS NOT NULL AND json_extract_string(facts, '$.road_condition') = 'wet' AND lat BETWEEN 52 AND 52.04 AND lon BETWEEN 13 AND 13.05 AND t_sec BETWEEN 20 AND 400 AND {VEHICLES} BETWEEN 1 AND 4""")
def p1(t):
    rows = P.scene_filter(t("frames"), road_condition="wet", bbox=(52.0, 52.04, 13.0, 13.05), time_range=(20.0, 400.0), vehicles_min=1, vehicles_max=4)
    return rows.select("frame_id", "mission_id", "t_sec", F.col("fact.road_condition").alias("road_condition"), "vehicles")


@query("p2_geo_box", ["frames"], f" SELECT frame_id, lat, lon FROM frames WHERE lat BETWEEN {LOW} AND {HIGH} AND lon BETWEEN {WEST} AND {EAST}")
def p2(t):
    return P.geo_box(t("frames"), LAT, LON, RADIUS).select("frame_id", "lat", "lon")


@query("p3_within_metres", ["frames"], f" SELECT frame_id, round({METRES}, 4) AS distance_m FROM frames WHERE {METRES} <= {RADIUS}e0")
def p3(t):
    return P.within_metres(t("frames"), LAT, LON, RADIUS).select("frame_id", F.round("distance_m", 4).alias("distance_m"))


@query("p3_within_enu", ["points"], " SELECT id, round(sqrt((tx - 10) * (tx - 10) + (ty - 10) * (ty - 10) + (tz - 1) * (tz - 1)), 6) AS distance_m FROM points WHERE (tx - 10) * (tx - 10) + (ty - 10) * (ty - 10) + (tz - 1) * (tz - 1) <= 64")
def p3_enu(t):
    return P.within_enu(t("points"), 10, 10, 1, 8).select("id", F.round("distance_m", 6).alias("distance_m"))


@query("p4_payload_filter", ["points"], " SELECT id, mission_id, robot_id FROM points WHERE type = 'frame' AND mission_id IN (1, 2, 3, 7) AND robot_id IN ('robot-1', 'robot-3')")
def p4(t):
    return P.payload_filter(t("points"), type="frame", missions=[1, 2, 3, 7], robots=["robot-1", "robot-3"]).select("id", "mission_id", "robot_id")


@query("p5_edges_at", ["edges"], " SELECT edge_id, mission_id, predicate FROM edges WHERE start_sec <= 12.5 AND end_sec > 12.5")
def p5(t):
    return P.edges_at(t("edges"), 12.5).select("edge_id", "mission_id", "predicate")


@query("p6_publishable", ["timeline"], " SELECT event_id, mission_id, type FROM timeline WHERE status = 'accepted' AND n_evidence > 0")
def p6(t):
    return P.publishable(t("timeline")).select("event_id", "mission_id", "type")


@query("p7_row_contracts", ["geometry", "edges", "tracks"], """
SELECT 'geometry' AS contract, sample_id AS id, 'metric_without_calibration' AS code FROM geometry WHERE metric_scale = 'metric' AND calibration_id IS NULL
UNION ALL SELECT 'geometry', sample_id, 'depth_out_of_range' FROM geometry WHERE depth_m NOT BETWEEN 0 AND 4.5
UNION ALL SELECT 'edge', CAST(edge_id AS VARCHAR), 'accepted_without_evidence' FROM edges WHERE status = 'accepted' AND n_evidence = 0
UNION ALL SELECT 'edge', CAST(edge_id AS VARCHAR), 'interval_order' FROM edges WHERE end_sec <= start_sec
UNION ALL SELECT 'track', observation_id, 'box_outside' FROM tracks WHERE x < 0 OR y < 0 OR x + w > 1 OR y + h > 1
UNION ALL SELECT 'track', observation_id, 'confidence_outside' FROM tracks WHERE confidence NOT BETWEEN 0 AND 1""")
def p7(t):
    parts = [("geometry", t("geometry"), P.geometry_rules(4.5), "sample_id"), ("edge", t("edges"), P.edge_rules(), "edge_id"), ("track", t("tracks"), P.track_rules(), "observation_id")]
    found = [P.check_rows(df, rules, [key]).select(F.lit(kind).alias("contract"), F.col(key).cast("string").alias("id"), "code") for kind, df, rules, key in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("p7_all_contracts", ["geometry", "edges", "timeline", "proposals"], """
, g AS (SELECT sample_id, depth_m, ex - CASE WHEN depth_m > 4.5 THEN 3 ELSE 0 END AS ex, cy - 1 AS cov, CASE WHEN cx > 9 THEN 3 ELSE 4 END AS len, CASE WHEN cz > 1 THEN 0.5e0 ELSE 1e0 END AS w FROM geometry)
SELECT 'sample' AS contract, sample_id AS id, 'extent_not_positive' AS code FROM g WHERE ex <= 0 UNION ALL SELECT 'sample', sample_id, 'quaternion_not_unit' FROM g WHERE w <> 1 UNION ALL SELECT 'sample', sample_id, 'covariance_negative' FROM g WHERE cov < 0
UNION ALL SELECT 'sample', sample_id, 'vector_length' FROM g WHERE len <> 4
UNION ALL SELECT 'mask', sample_id, 'bit_count' FROM geometry WHERE cx > 9 OR cz > 1.5
UNION ALL SELECT 'delta', CAST(edge_id AS VARCHAR), 'node_or_edge' FROM edges WHERE edge_id % 12 = 0 UNION ALL SELECT 'delta', CAST(edge_id AS VARCHAR), 'open_predicate_accepted' FROM edges WHERE status = 'accepted' AND edge_id % 10 = 3 UNION ALL SELECT 'delta', CAST(edge_id AS VARCHAR), 'band_missing' FROM edges WHERE edge_id % 10 = 4
UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), 'accepted_without_evidence' FROM timeline WHERE status = 'accepted' AND n_evidence = 0 UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), 'interval_order' FROM timeline WHERE end_sec - event_id % 3 <= start_sec
UNION ALL SELECT 'answer', CAST(proposal_id AS VARCHAR), 'accepted_without_evidence' FROM proposals WHERE status = 'accepted' AND proposal_id % 3 = 0 UNION ALL SELECT 'answer', CAST(proposal_id AS VARCHAR), 'causal_accepted' FROM proposals WHERE status = 'accepted' AND proposal_id % 7 = 0""")
def p7_all(t):
    from ..operators.graph import GEOMETRIC

    f = F.col
    short = F.when(f("cx") > 9, F.array(*[F.lit(1.0)] * 3)).otherwise(F.array(*[F.lit(1.0)] * 4))
    samples = t("geometry").withColumn("ex", f("ex") - F.when(f("depth_m") > 4.5, 3).otherwise(0)).withColumn("covariance_diag", F.array(F.lit(0.5), f("cy") - 1)).withColumn("vector", short).withColumn("dim", F.lit(4))
    samples = samples.withColumn("quaternion", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.when(f("cz") > 1, 0.5).otherwise(1.0)))
    masks = t("geometry").withColumn("width", F.lit(4)).withColumn("height", F.lit(2)).withColumn("bits", F.when(f("cx") > 9, "0101010").when(f("cz") > 1.5, "0101010x").otherwise("01010101"))
    k = f("edge_id")
    deltas = t("edges").withColumn("node_id", F.when(k % 12 == 0, "s1")).withColumn("predicate", F.when(k % 10 == 3, "holds").when(k % 10 == 4, "distance_band").otherwise(f("predicate"))).withColumn("band_max", F.lit(None).cast("double"))
    events = t("timeline").withColumn("end_sec", f("end_sec") - f("event_id") % 3)
    answers = t("proposals").withColumn("n_evidence", f("proposal_id") % 3).withColumn("program", F.when(f("proposal_id") % 7 == 0, "caused(a, b)").otherwise("count(car, at=1)"))
    parts = [("sample", samples, P.sample_rules(), "sample_id"), ("mask", masks, P.mask_rules(), "sample_id"), ("delta", deltas, P.delta_rules(GEOMETRIC), "edge_id"), ("event", events, P.event_rules(), "event_id"), ("answer", answers, P.answer_rules(), "proposal_id")]
    found = None
    for kind, df, rules, key in parts:
        rows = P.check_rows(df, rules, [key]).select(F.lit(kind).alias("contract"), F.col(key).cast("string").alias("id"), "code")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("p8_pending", ["frames"], " SELECT frame_id FROM frames WHERE caption IS NULL AND caption_skip_reason IS NULL AND (created_at, frame_id) > (TIMESTAMP '2024-01-10', 100)")
def p8(t):
    return P.pending(t("frames"), (CURSOR, 100)).select("frame_id")


@query("p11_merge_facts", [], """SELECT event_id AS frame_id, CASE WHEN event_id % 2 = 0 THEN 'late' ELSE event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS "user", 'x' AS early FROM events""")
def p11(t):
    early = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("early"), F.lit("x"))
    late = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("kind"), F.lit("late"), F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = t.raw("events").select(F.col("event_id").alias("frame_id"), P.merge_facts(early, late).alias("m"))
    return merged.select("frame_id", *[F.col("m")[k].alias(k) for k in ("kind", "user", "early")])


@query("p12_to_enu", ["frames"], """
, first AS (SELECT mission_id, arg_min(lat, (t_sec, frame_id)) AS lat0, arg_min(lon, (t_sec, frame_id)) AS lon0 FROM frames WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY mission_id)
SELECT frame_id, round((lon - lon0) * 111320e0 * cos(radians(lat0)), 4) AS east_m, round((lat - lat0) * 111320e0, 4) AS north_m FROM frames LEFT JOIN first USING (mission_id)""")
def p12(t):
    return P.to_enu(t("frames")).select("frame_id", F.round("east_m", 4).alias("east_m"), F.round("north_m", 4).alias("north_m"))


@query("p13_normalise_detections", [], """
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS frame_id, l_returnflag AS label, l_quantity * 10 - 40 AS x1, l_discount * 1000 AS y1, l_quantity * 10 + 100 AS x2, l_discount * 1000 + 80 AS y2, l_tax * 20 AS score FROM lineitem),
u AS (SELECT frame_id, CASE label WHEN 'A' THEN 1 ELSE 2 END AS prompt_id, least(1, greatest(0, x1 / 400)) AS x, least(1, greatest(0, y1 / 300)) AS y, least(1, greatest(0, x2 / 400)) AS x2, least(1, greatest(0, y2 / 300)) AS y2, least(1, greatest(0, score)) AS confidence FROM d WHERE label IN ('A', 'R'))
SELECT frame_id, CAST(prompt_id AS BIGINT) AS prompt_id, round(x, 6) AS x, round(y, 6) AS y, round(x2 - x, 6) AS w, round(y2 - y, 6) AS h, round(confidence, 6) AS confidence FROM u WHERE x2 - x > 0 AND y2 - y > 0""")
def p13(t):
    d = t.raw("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"), F.col("l_returnflag").alias("label"), (F.col("l_quantity") * 10 - 40).alias("x1"), (F.col("l_discount") * 1000).alias("y1"),
        (F.col("l_quantity") * 10 + 100).alias("x2"), (F.col("l_discount") * 1000 + 80).alias("y2"), (F.col("l_tax") * 20).alias("score"), F.lit(400.0).alias("width"), F.lit(300.0).alias("height"),
    )
    prompts = t.spark.createDataFrame([(" A ", 1), ("r", 2)], "label string, prompt_id long")
    return P.normalise_detections(d, prompts).select("frame_id", "prompt_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h", "confidence")])


@query("p14_signal_drift", ["points"], """
, first AS (SELECT mission_id, arg_min(embedding, (t_sec, id)) AS v0 FROM points GROUP BY mission_id)
SELECT id, round(greatest(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v0 AS DOUBLE[])), list_sum(list_transform(list_zip(embedding, v0), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) / len(embedding)), 5) AS drift FROM points JOIN first USING (mission_id)""")
def p14(t):
    thumbs = t("points").select("id", "mission_id", "t_sec", F.col("id").alias("frame_id"), F.col("embedding").alias("pixels"))
    return P.signal_drift(thumbs).select("id", F.round("drift", 5).alias("drift"))


@query("w1_latest", ["packets"], " SELECT session_id, arg_max(packet_id, (t_device, packet_id)) AS packet_id, max(t_device) AS t_device FROM packets GROUP BY session_id")
def w1(t):
    return P.latest(t("packets").select("session_id", "packet_id", "t_device"), ["session_id"], ["t_device", "packet_id"])


@query("w10_sample_nth", ["frames"], """
, p AS (SELECT frame_id, mission_id, row_number() OVER (PARTITION BY mission_id ORDER BY t_sec, frame_id) - 1 AS place FROM frames)
SELECT frame_id, mission_id, place FROM p WHERE place % 7 = 0 AND place // 7 < 12""")
def w10(t):
    return P.sample_nth(t("frames"), ["mission_id"], ["t_sec", "frame_id"], 7, 12).select("frame_id", "mission_id", F.col("place").cast("bigint").alias("place"))


@query("w10_clip_windows", ["frames"], """
, p AS (SELECT frame_id, mission_id, row_number() OVER (PARTITION BY mission_id ORDER BY t_sec, frame_id) - 1 AS place FROM frames),
c AS (SELECT *, place // 16 AS clip, count(*) OVER (PARTITION BY mission_id, place // 16) AS n FROM p)
SELECT mission_id, clip, n, frame_id AS carrier FROM c WHERE place = clip * 16 + n // 2""")
def w10_clips(t):
    return P.clip_windows(t("frames"), ["mission_id"], ["t_sec", "frame_id"], 16).select("mission_id", "clip", "n", F.col("frame_id").alias("carrier"))


@query("w11_nearest_rank", ["frames"], """
, p AS (SELECT mission_id, hist_diff, row_number() OVER (PARTITION BY mission_id ORDER BY hist_diff) AS place, count(*) OVER (PARTITION BY mission_id) AS n FROM frames WHERE hist_diff IS NOT NULL)
SELECT mission_id, hist_diff AS percentile, n FROM p WHERE place = greatest(1, ceil(0.95e0 * n))""")
def w11(t):
    return K.nearest_rank(t("frames"), ["mission_id"], "hist_diff", 0.95)


@query("a1_counts_by", ["missions"], """
, c AS (SELECT unnest(['queued', 'running', 'failed', 'done', 'cancelled']) AS status)
SELECT c.status, count(m.mission_id) AS n FROM c LEFT JOIN missions m ON m.status = c.status GROUP BY c.status""")
def a1(t):
    return A.counts_by(t("missions"), "status", ["queued", "running", "failed", "done", "cancelled"])


@query("a2_caption_health", ["frames"], """
SELECT count(*) AS total, count(caption) AS captioned, count(caption_skip_reason) AS skipped, count(*) FILTER (WHERE caption IS NULL AND caption_skip_reason IS NULL) AS missing,
round(count(*) FILTER (WHERE caption IS NULL AND caption_skip_reason IS NULL) / nullif(count(*) FILTER (WHERE caption_skip_reason IS NULL), 0), 6) AS null_rate,
round(avg(caption_confidence), 6) AS mean_confidence, round(quantile_cont(caption_confidence, 0.95), 6) AS p95_confidence FROM frames""")
def a2(t):
    row = A.caption_health(t("frames"))
    return row.select("total", "captioned", "skipped", "missing", *[F.round(c, 6).alias(c) for c in ("null_rate", "mean_confidence", "p95_confidence")])


@query("a3_model_breakdown", ["frames"], " SELECT caption_model, count(*) AS n FROM frames WHERE caption_model IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def a3(t):
    return A.model_breakdown(t("frames"))


@query("a4_annotation_roi", ["frames", "jobs"], """
, r AS (SELECT count(*) AS annotated, min(created_at) AS first_at, max(created_at) AS last_at, count(DISTINCT strftime(created_at, '%Y-%m')) AS months FROM frames WHERE al_tag = 'annotated'),
d AS (SELECT *, CASE WHEN first_at IS NOT NULL THEN greatest((epoch_us(last_at) - epoch_us(first_at)) / 86400e6, 1e0) END AS days FROM r),
w AS (SELECT *, CASE WHEN days >= 7 THEN annotated / (days / 7) END AS rate FROM d),
j AS (SELECT count(*) FILTER (WHERE type = 'supervised_finetune') AS triggered, count(*) FILTER (WHERE type = 'supervised_finetune' AND progress LIKE '%true%') AS accepted, count(*) FILTER (WHERE type = 'reembed' AND status = 'finished') AS reembeds FROM jobs)
SELECT annotated, months, round(days, 4) AS days, round(rate, 4) AS per_week, triggered, accepted, reembeds, round(accepted / triggered, 3) AS acceptance_rate, accepted * 3 AS minutes_saved,
  CASE WHEN rate IS NULL THEN 'INSUFFICIENT_DATA' WHEN rate < 0.5 THEN 'LOW_FREQUENCY' WHEN rate < 2 THEN 'MODERATE_FREQUENCY' ELSE 'HIGH_FREQUENCY' END AS verdict FROM w, j""")
def a4(t):
    rows = A.annotation_roi(t("frames"), t("jobs"))
    return rows.select("annotated", "months", F.round("days", 4).alias("days"), F.round("per_week", 4).alias("per_week"), "triggered", "accepted", "reembeds", "acceptance_rate", "minutes_saved", "verdict")


@query("a5_robots", ["missions"], " SELECT DISTINCT robot_id FROM missions WHERE robot_id IS NOT NULL ORDER BY 1")
def a5(t):
    return A.robots(t("missions"))


@query("a6_session_summary", ["packets"], """
SELECT session_id, count(*) AS packets, round(greatest(0, max(t_device) - min(t_device)), 3) AS duration_sec, count(*) FILTER (WHERE sensor_type = 'camera') AS camera,
count(*) FILTER (WHERE sensor_type = 'gps') AS gps, arg_max(packet_id, (t_device, packet_id)) AS last_packet FROM packets GROUP BY session_id""")
def a6(t):
    rows = A.session_summary(t("packets"))
    of = lambda s: F.coalesce(F.col("by_sensor")[s], F.lit(0)).alias(s)
    return rows.select("session_id", "packets", F.round("duration_sec", 3).alias("duration_sec"), of("camera"), of("gps"), "last_packet")


@query("a7_sensor_profile", ["packets"], """
SELECT session_id, array_to_string(list_sort(list_distinct(list(sensor_type))), ',') AS sensors,
array_to_string(list_sort(list_distinct(list(CASE sensor_type WHEN 'gps' THEN 'position' WHEN 'imu' THEN 'orientation' WHEN 'magnetometer' THEN 'orientation' WHEN 'camera' THEN 'vision' END) FILTER (WHERE sensor_type <> 'barometer'))), ',') AS capabilities FROM packets GROUP BY session_id""")
def a7(t):
    rows = A.sensor_profile(t("packets"), {"gps": "position", "imu": "orientation", "magnetometer": "orientation", "camera": "vision"})
    return rows.select("session_id", F.array_join("sensors", ",").alias("sensors"), F.array_join("capabilities", ",").alias("capabilities"))


@query("a8_risk_summary", ["frames"], """
, e AS (SELECT mission_id, frame_id % 7 AS k, CASE frame_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'unknown' END AS risk, CASE frame_id % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'split' ELSE 'unknown' END AS agreement FROM frames)
SELECT mission_id, count(*) AS analysed, count(*) FILTER (WHERE risk = 'high') AS high_risk, count(*) FILTER (WHERE agreement = 'full') AS "full", count(*) FILTER (WHERE agreement = 'split') AS split, count(*) FILTER (WHERE agreement = 'unknown') AS "unknown" FROM e WHERE k < 4 GROUP BY mission_id""")
def a8(t):
    i = F.col("frame_id")
    said = lambda k, cond: F.when(cond, F.concat(F.lit(f'"{k}":"'), F.when(i % (3 if k == "risk_level" else 5) == 0, "high" if k == "risk_level" else "full").otherwise("low" if k == "risk_level" else "split"), F.lit('"'))).otherwise("")
    answer = F.concat(F.lit('{"service_unavailable":'), F.when(i % 7 == 4, "true").otherwise("false"), F.when(i % 7 == 5, ',"parse_error":"bad"').otherwise(""), F.lit(',"understanding":{'), said("risk_level", i % 3 < 2), F.lit('},"mixture_of_experts":{'), said("expert_agreement", i % 5 < 2), F.lit("}}"))
    frames = t("frames").withColumn("facts", F.when(i % 7 == 6, '{"expert":[1]}').otherwise(F.concat(F.lit('{"expert":'), answer, F.lit("}"))))
    kinds = [F.coalesce(F.try_element_at("agreement", F.lit(k)), F.lit(0)).alias(k) for k in ("full", "split", "unknown")]
    return A.risk_summary(frames).select("mission_id", "analysed", "high_risk", *kinds)


@query("a9_segment_summary", ["tracks"], """
, m AS (SELECT concat(mission_id, ':', t_sec) AS frame_id, observation_id AS mask_id, label, confidence AS score, w * h AS area FROM tracks),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, area DESC, mask_id) AS place FROM m WHERE area >= 0.02)
SELECT frame_id, CAST(count(*) AS BIGINT) AS n_masks, CAST(count(*) FILTER (WHERE label = 'car') AS BIGINT) AS cars, round(avg(area), 6) AS mean_area, round(max(area), 6) AS max_area FROM k WHERE place <= 4 GROUP BY frame_id""")
def a9(t):
    masks = t("tracks").select(F.concat_ws(":", "mission_id", "t_sec").alias("frame_id"), F.col("observation_id").alias("mask_id"), "label", F.col("confidence").alias("score"), (F.col("w") * F.col("h")).alias("area"))
    rows = A.segment_summary(masks, 0.02, 4)
    return rows.select("frame_id", "n_masks", F.coalesce(F.col("by_label")["car"], F.lit(0)).alias("cars"), F.round("mean_area", 6).alias("mean_area"), F.round("max_area", 6).alias("max_area"))


@query("a10_al_tags", ["frames"], """
, s AS (SELECT frame_id, mission_id, CASE WHEN frame_id % 13 <> 0 THEN (frame_id % 97) / 96e0 ELSE 0.5 END AS dist, coalesce(nullif(caption_confidence, 0), 0.5) AS sure, CASE WHEN frame_id % 3 = 0 THEN (frame_id % 11) / 10e0 ELSE 0.5 END AS surprise, mission_id % 2 = 0 AS known FROM frames),
c AS (SELECT *, CASE WHEN known THEN 0.35e0 * dist + 0.25e0 * (1e0 - sure) + 0.40e0 * surprise ELSE 0.60e0 * dist + 0.40e0 * (1e0 - sure) END AS al_score FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY al_score DESC, frame_id) AS place FROM c)
SELECT frame_id, round(al_score, 9) AS al_score, CASE WHEN place <= 50 THEN 'needs_annotation' WHEN dist >= 0.7 THEN 'novel' END AS al_tag FROM p""")
def a10(t):
    k = F.col("frame_id")
    frames = t("frames").withColumn("dist", F.when(k % 13 != 0, (k % 97) / F.lit(96.0))).withColumn("surprise", F.when((k % 3 == 0) & (F.col("mission_id") % 2 == 0), (k % 11) / F.lit(10.0)))
    return A.al_tags(frames, 50, 0.7).select("frame_id", F.round("al_score", 9).alias("al_score"), "al_tag")


@query("a15_voxelise", ["geometry"], """
SELECT mission_id AS cloud_id, floor(cx / 2.5) AS vx, floor(cy / 2.5) AS vy, floor(cz / 2.5) AS vz, round(avg(cx), 6) AS x, round(avg(cy), 6) AS y, round(avg(cz), 6) AS z, count(*) AS n FROM geometry GROUP BY ALL""")
def a15(t):
    cloud = t("geometry").select(F.col("mission_id").alias("cloud_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    rows = A.voxelise(cloud, 2.5)
    return rows.select("cloud_id", *[F.col(c).cast("double").alias(c) for c in ("vx", "vy", "vz")], *[F.round(c, 6).alias(c) for c in "xyz"], "n")


@query("a15_merge_clouds", ["geometry"], """
SELECT mission_id AS cloud_id, round(cx, 6) AS x, round(cy, 6) AS y, round(cz, 6) AS z FROM geometry WHERE t_sec < 1
UNION ALL SELECT mission_id, round(0 - cy + 1, 6), round(cx + 2, 6), round(cz - 0.5, 6) FROM geometry WHERE t_sec >= 3""")
def a15_merge(t):
    cloud = t("geometry").select(F.col("mission_id").alias("cloud_id"), "t_sec", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    both = A.merge_clouds(cloud.filter("t_sec < 1").drop("t_sec"), cloud.filter("t_sec >= 3").drop("t_sec"), [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, -0.5], [0, 0, 0, 1]])
    return both.select("cloud_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("a17_gap_coverage", ["signals"], """
, b AS (SELECT mission_id, CAST(sum(CASE WHEN good THEN 0 ELSE 1 END) AS BIGINT) AS skipped, CAST(sum(CASE WHEN NOT good AND frame_id % 50 <> 7 THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM signals GROUP BY mission_id)
SELECT mission_id, skipped, covered FROM b WHERE skipped <> covered""")
def a17(t):
    bad = t("signals")
    stages = bad.select("mission_id", (~F.col("good")).cast("int").alias("skipped"))
    gaps = bad.select("mission_id", (~F.col("good") & (F.col("frame_id") % 50 != 7)).cast("int").alias("skipped_frames"))
    return A.gap_coverage(stages, gaps)


@query("a18_retrain_due", ["frames", "jobs"], """
, r AS (SELECT count(*) FILTER (WHERE al_tag = 'annotated') AS annotated, count(*) FILTER (WHERE al_tag = 'annotated') - 120 AS fresh FROM frames),
j AS (SELECT c, count(*) FILTER (WHERE type = 'supervised_finetune' AND CASE WHEN job_id % 3 = 1 THEN 'pending' WHEN job_id % 3 = 2 THEN 'running' ELSE status END IN ('pending', 'running') AND (c = 'busy' OR status = 'none')) AS active FROM jobs, (SELECT unnest(['busy', 'calm']) AS c) GROUP BY c)
SELECT c AS state, annotated, fresh, active, annotated >= 50 AND fresh >= 100 AND active = 0 AS due FROM r, j""")
def a18(t):
    jobs = t("jobs").withColumn("status", F.when(F.col("job_id") % 3 == 1, "pending").when(F.col("job_id") % 3 == 2, "running").otherwise(F.col("status")))
    found = {"busy": A.retrain_due(t("frames"), jobs, 120), "calm": A.retrain_due(t("frames"), t("jobs"), 120)}
    busy, calm = (df.select(F.lit(name).alias("state"), "*") for name, df in found.items())
    return busy.unionByName(calm)


@query("a20_mission_report", ["frames"], """
SELECT mission_id, count(*) AS frames, max(t_sec) - min(t_sec) AS duration_sec, count(*) FILTER (WHERE al_tag = 'needs_annotation') AS needs_annotation,
count(*) FILTER (WHERE al_tag = 'novel') AS novel, count(*) FILTER (WHERE al_tag = 'annotated') AS annotated, max(al_score) AS best_score FROM frames GROUP BY mission_id""")
def a20(t):
    return A.mission_report(t("frames"))


@query("a21_count_disagreement", ["tracks"], """
, a AS (SELECT mission_id, t_sec, label, count(*) AS active FROM tracks WHERE state IN ('tentative', 'confirmed', 'occluded') GROUP BY ALL),
c AS (SELECT mission_id, t_sec, label, count(*) AS counted FROM tracks GROUP BY ALL)
SELECT mission_id, t_sec, label, counted, coalesce(active, 0) AS active, abs(counted - coalesce(active, 0)) AS off FROM c LEFT JOIN a USING (mission_id, t_sec, label) WHERE counted <> coalesce(active, 0)""")
def a21(t):
    counts = t("tracks").groupBy("mission_id", "t_sec", "label").agg(F.count("*").alias("counted"))
    return A.count_disagreement(t("tracks"), counts).select("mission_id", "t_sec", "label", "counted", "active", "off")


@query("a22_mission_summary", ["missions", "tracks", "timeline", "geometry"], """
, n AS (SELECT mission_id, label, count(*) AS n FROM tracks GROUP BY ALL), h AS (SELECT mission_id, string_agg(concat(label, '=', n), ',' ORDER BY label) AS labels FROM n GROUP BY 1),
k AS (SELECT mission_id, count(DISTINCT track_id) AS tracks, count(*) AS observations FROM tracks GROUP BY 1), e AS (SELECT mission_id, count(*) AS accepted_events FROM timeline WHERE status = 'accepted' GROUP BY 1), g AS (SELECT mission_id, count(*) AS samples FROM geometry GROUP BY 1)
SELECT mission_id, status AS profile, coalesce(tracks, 0) AS tracks, coalesce(observations, 0) AS observations, coalesce(labels, '') AS labels, coalesce(accepted_events, 0) AS accepted_events, coalesce(samples, 0) AS samples,
  CASE WHEN mission_id % 5 = 0 THEN 'unavailable' WHEN mission_id % 2 = 0 THEN 'metric' ELSE 'relative' END AS metric_scale, CASE mission_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'depth' ELSE 'depth,mask' END AS degradations
FROM missions LEFT JOIN h USING (mission_id) LEFT JOIN k USING (mission_id) LEFT JOIN e USING (mission_id) LEFT JOIN g USING (mission_id)""")
def a22(t):
    i, word = F.col("mission_id"), F.lit
    stages = F.when(i % 3 == 1, F.array(word("depth"))).when(i % 3 == 2, F.array(word("mask"), word("depth"), word("mask")))
    runs = t("missions").select("mission_id", F.col("status").alias("profile"), F.when(i % 5 != 0, F.when(i % 2 == 0, "metric").otherwise("relative")).alias("metric_scale"), stages.alias("degradations"))
    rows = A.mission_summary(t("tracks"), t("timeline"), t("geometry"), runs)
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], word("="), e["value"])), ",")
    return rows.withColumn("labels", labels).withColumn("degradations", F.array_join("degradations", ","))


def _prototype_sql(track: str, tau: str) -> str:
    """The recursion itself, one observation after the other."""
    return f"""
, o AS (SELECT {track} AS track_id, robot_id AS space, t_sec, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY {track}, robot_id ORDER BY t_sec, id) AS n FROM points),
p AS (SELECT track_id, space, n, t_sec, v FROM o WHERE n = 1
  UNION ALL SELECT o.track_id, o.space, o.n, o.t_sec, list_transform(list_zip(p.v, o.v), lambda x: exp((p.t_sec - o.t_sec) / {tau}) * x[1] + (1 - exp((p.t_sec - o.t_sec) / {tau})) * x[2]) FROM p JOIN o ON o.track_id = p.track_id AND o.space = p.space AND o.n = p.n + 1),
l AS (SELECT track_id, space, arg_max(v, n) AS v FROM p GROUP BY ALL)
SELECT track_id, space, CAST(unnest(generate_series(1, len(v))) AS BIGINT) AS dim, round(unnest(v), 5) AS x FROM l"""


def _prototypes(t, track, tau):
    rows = A.prototypes(t("points").select(track.alias("track_id"), F.col("robot_id").alias("space"), "t_sec", F.col("id").alias("observation_id"), F.col("embedding").alias("vector")), tau)
    return rows.select("track_id", "space", F.posexplode("prototype").alias("at", "x")).select("track_id", "space", (F.col("at") + 1).cast("bigint").alias("dim"), F.round("x", 5).alias("x"))


@query("a12_prototypes", ["points"], _prototype_sql("mission_id", "2e0"))
def a12(t):
    return _prototypes(t, F.col("mission_id"), 2.0)


@query("a12_whole_prototypes", ["points"], _prototype_sql("mission_id % 3", "0.5e0"))
def a12_whole(t):
    return _prototypes(t, F.col("mission_id") % 3, 0.5)


@query("k1_vector_topk", ["points"], """
, s AS (SELECT q.id AS query_id, p.id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 9) AS score FROM points q JOIN points p ON q.id <> p.id AND p.type = 'frame' WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s)
SELECT query_id, id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def k1(t):
    points = t("points")
    found = K.vector_topk(P.payload_filter(points, type="frame"), points.filter(F.col("id") % 20 == 0), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query("k1_cell_topk", ["points"], """
, s AS (SELECT q.id AS query_id, p.id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 9) AS score FROM points q JOIN points p ON q.id <> p.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s)
SELECT query_id, id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def k1_cells(t):
    points = t("points")
    found = C.search(C.build(points), points, 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query("j10_rerank", ["points"], """
, c AS (SELECT id AS query_id, id + 1 AS id, 0.5e0 + (id % 10) / 20e0 AS score FROM points UNION ALL SELECT id, id + 2, 0.5e0 + (id % 7) / 20e0 FROM points),
d AS (SELECT id AS query_id, id + 2 AS id, 0.1e0 + (id % 3) / 10e0 AS score FROM points WHERE id % 4 <> 1)
SELECT c.query_id, c.id, round(CASE WHEN d.score IS NULL THEN c.score ELSE 0.7e0 * c.score + 0.3e0 * d.score END, 6) AS blend FROM c LEFT JOIN d USING (query_id, id)""")
def j10(t):
    p = t("points")
    clip = p.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("id"), (0.5 + (F.col("id") % 10) / 20.0).alias("score")).unionByName(p.select(F.col("id").alias("query_id"), (F.col("id") + 2).alias("id"), (0.5 + (F.col("id") % 7) / 20.0).alias("score")))
    dino = p.filter("id % 4 <> 1").select(F.col("id").alias("query_id"), (F.col("id") + 2).alias("id"), (0.1 + (F.col("id") % 3) / 10.0).alias("score"))
    return K.rerank(clip, dino).select("query_id", "id", F.round("blend", 6).alias("blend"))


@query("k2_scene_query", ["frames"], """
, f AS (SELECT frame_id, created_at FROM frames WHERE facts IS NOT NULL AND json_extract_string(facts, '$.road_condition') = 'dry' ORDER BY created_at DESC, frame_id LIMIT 100),
p AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, frame_id) - 1 AS i FROM f),
s AS (SELECT frame_id, (frame_id % 100) / 100e0 AS score FROM frames WHERE frame_id % 3 = 0)
SELECT frame_id, round(coalesce(score, 1 - i / 20e0), 6) AS score FROM p LEFT JOIN s USING (frame_id) ORDER BY score IS NULL, s.score DESC, i LIMIT 20""")
def k2(t):
    frames = t("frames")
    scores = frames.filter("frame_id % 3 = 0").select("frame_id", ((F.col("frame_id") % 100) / 100.0).alias("score"))
    return K.scene_query(frames, scores, 20, road_condition="dry").select("frame_id", F.round("score", 6).alias("score"))


@query("k3_pose_query", ["points"], f" SELECT id, round({METRES}, 4) AS distance_m FROM points WHERE {METRES} <= {RADIUS}e0 ORDER BY {METRES}, id LIMIT 25")
def k3(t):
    return K.pose_query(t("points"), 25, gps=(LAT, LON), radius_m=RADIUS).select("id", F.round("distance_m", 4).alias("distance_m"))


@query("k4_last_visits", ["frames"], f" SELECT frame_id, created_at FROM frames WHERE lat BETWEEN {LOW} AND {HIGH} AND lon BETWEEN {WEST} AND {EAST} ORDER BY created_at DESC, frame_id LIMIT 3")
def k4(t):
    return K.last_visits(t("frames"), LAT, LON, RADIUS).select("frame_id", "created_at")


@query("k5_annotation_queue", ["frames"], " SELECT frame_id, al_score, (SELECT count(*) FROM frames WHERE al_tag = 'novel') AS total FROM frames WHERE al_tag = 'novel' ORDER BY al_score DESC NULLS LAST, frame_id LIMIT 30")
def k5(t):
    return K.annotation_queue(t("frames"), "novel", 30).select("frame_id", "al_score", "total")


@query("k6_recent", ["frames"], " SELECT frame_id, created_at FROM frames ORDER BY created_at DESC, frame_id LIMIT 40")
def k6(t):
    return K.recent(t("frames").select("frame_id", "created_at"), "created_at", "frame_id", 40)


@query("k7_route_captions", ["frames"], " SELECT frame_id, CASE WHEN row_number() OVER (PARTITION BY mission_id ORDER BY hist_diff DESC, frame_id) <= 10 THEN 'large' ELSE 'small' END AS model FROM frames")
def k7(t):
    return K.route_captions(t("frames"), 10).select("frame_id", "model")


@query("k8_list_events", ["timeline"], " SELECT event_id, start_sec, type FROM timeline WHERE mission_id = 7 AND status = 'accepted' ORDER BY start_sec, event_id")
def k8(t):
    return K.list_rows(t("timeline"), 7, status="accepted").select("event_id", "start_sec", "type")


@query("j14_enrich_by_time", ["frames", "packets"], """
, s AS (SELECT session_id % 25 AS mission_id, round_even(CAST(packet_id % 2000 AS DOUBLE) * 0.25e0, 3) AS at, arg_max(value, packet_id) AS value FROM packets GROUP BY ALL)
SELECT frame_id, value FROM frames LEFT JOIN s ON frames.mission_id = s.mission_id AND round_even(t_sec, 3) = s.at""")
def j14(t):
    from ..operators.joins import enrich_by_time

    samples = t("packets").select((F.col("session_id") % 25).alias("mission_id"), ((F.col("packet_id") % 2000).cast("double") * 0.25).alias("t_sec"), "value", "packet_id")
    return enrich_by_time(t("frames"), samples).select("frame_id", "value")
