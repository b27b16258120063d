"""Domain tables of missions, derived from the given star-schema tables.

Each is one SELECT in the SQL that Spark and DuckDB share, with the tables'
names in braces, so queries and their SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Functions whose names differ: (in Spark, in DuckDB).
DIALECT = {"EPOCH_US": ("unix_micros", "epoch_us"), "BIGSTR": ("string", "varchar")}

DOMAIN = {
    # Indexed frames with captions, facts and places.
    "frames": """
SELECT event_id AS frame_id, CAST(user_id % 25 AS BIGINT) AS mission_id, CAST(event_id % 2000 AS DOUBLE) * 0.25e0 AS t_sec, ts AS created_at,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS caption,
       CASE WHEN event_id % 18 = 0 THEN 'dark' ELSE NULL END AS caption_skip_reason,
       CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'model-a' ELSE 'model-b' END AS caption_model,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) / 100e0 END AS caption_confidence,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('{{"road_condition":"', CASE event_id % 3 WHEN 0 THEN 'wet' WHEN 1 THEN 'dry' ELSE 'snow' END,
            '","vehicle_groups":[{{"count":', CAST(event_id % 4 AS {BIGSTR}), ',"type":"car"}},{{"count":', CAST(event_id % 3 AS {BIGSTR}), ',"type":"truck"}}]}}') END AS facts,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE 52e0 + CAST(event_id % 100 AS DOUBLE) * 0.0005e0 END AS lat,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE 13e0 + CAST(event_id % 77 AS DOUBLE) * 0.0007e0 END AS lon,
       CASE event_id % 4 WHEN 0 THEN 'needs_annotation' WHEN 1 THEN 'novel' WHEN 2 THEN 'annotated' ELSE NULL END AS al_tag,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS al_score, value AS hist_diff, event_type AS kind
FROM {events}""",
    # One row a mission, with its robot and when it came.
    "missions": """
SELECT c_custkey AS mission_id, concat('robot-', CAST(c_nationkey AS {BIGSTR})) AS robot_id, CAST(c_custkey % 9 AS BIGINT) AS site_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'queued' WHEN 'MACHINERY' THEN 'running' WHEN 'FURNITURE' THEN 'failed' ELSE 'done' END AS status,
       40e0 + CAST(c_custkey % 37 AS DOUBLE) * 0.25e0 AS lat, 10e0 + CAST(c_custkey % 41 AS DOUBLE) * 0.25e0 AS lon, c_acctbal AS size_bytes
FROM {customer}""",
    "sites": """
SELECT s_suppkey AS site_id, 40e0 + CAST(s_suppkey % 35 AS DOUBLE) * 0.25e0 + 0.01e0 AS lat, 10e0 + CAST(s_suppkey % 39 AS DOUBLE) * 0.25e0 + 0.005e0 AS lon FROM {supplier}""",
    # Sensor packets of sessions.
    "packets": """
SELECT event_id AS packet_id, user_id AS session_id,
       CASE event_type WHEN 'view' THEN 'camera' WHEN 'signup' THEN 'gps' WHEN 'purchase' THEN 'imu' WHEN 'error' THEN 'barometer' ELSE 'magnetometer' END AS sensor_type,
       CAST({EPOCH_US}(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1e6 AS t_device, value, props AS payload, ts
FROM {events}""",
    # Vector points of frames; the vector itself is `embedding`.
    "points": """
SELECT vec_id AS id, embedding, CAST(label AS BIGINT) AS mission_id, concat('robot-', CAST(label % 4 AS {BIGSTR})) AS robot_id, CASE WHEN vec_id % 8 = 0 THEN 'tile' ELSE 'frame' END AS type,
       CAST(vec_id % 300 AS DOUBLE) * 0.5e0 AS t_sec, 52e0 + CAST(vec_id % 60 AS DOUBLE) * 0.0004e0 AS lat, 13e0 + CAST(vec_id % 71 AS DOUBLE) * 0.0006e0 AS lon,
       CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(vec_id % 40 AS DOUBLE) END AS tx, CAST(vec_id % 30 AS DOUBLE) AS ty, CAST(vec_id % 5 AS DOUBLE) AS tz
FROM {embeddings}""",
    # 3D samples of subjects: one a mission, subject and tick.
    "geometry": """
SELECT mission_id, concat('s', CAST(s AS {BIGSTR})) AS subject_id, concat(CAST(mission_id AS {BIGSTR}), '-s', CAST(s AS {BIGSTR}), '-', CAST(tick AS {BIGSTR})) AS sample_id,
       CAST(tick AS DOUBLE) * 0.5e0 AS t_sec, q * 0.2e0 AS cx, d * 50e0 AS cy, x * 25e0 AS cz, 0.5e0 + CAST(p % 5 AS DOUBLE) * 0.75e0 AS ex, 0.5e0 + CAST(p % 3 AS DOUBLE) AS ey,
       0.5e0 + CAST(p % 4 AS DOUBLE) * 0.5e0 AS ez, 1e0 + CAST(p % 9 AS DOUBLE) * 0.5e0 AS depth_m, CASE WHEN k % 11 = 0 THEN 'relative' ELSE 'metric' END AS metric_scale,
       CASE WHEN k % 13 = 0 THEN NULL ELSE 'cal-1' END AS calibration_id
FROM (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS mission_id, l_linenumber AS s, l_orderkey % 8 AS tick, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS x, max(l_partkey) AS p, max(l_suppkey) AS k
      FROM {lineitem} GROUP BY 1, 2, 3) AS g""",
    # Track observations (2D) at the same keys.
    "tracks": """
SELECT mission_id, concat('s', CAST(s AS {BIGSTR})) AS track_id, concat('obs-', CAST(mission_id AS {BIGSTR}), '-', CAST(s AS {BIGSTR}), '-', CAST(tick AS {BIGSTR})) AS observation_id,
       CAST(tick AS DOUBLE) * 0.5e0 AS t_sec, CASE s % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'box' END AS label,
       CASE WHEN k % 7 = 0 THEN 'occluded' WHEN k % 9 = 0 THEN 'lost' WHEN k % 8 = 0 THEN 'tentative' ELSE 'confirmed' END AS state,
       d * 5e0 AS x, t * 5e0 AS y, 0.1e0 + CAST(p % 5 AS DOUBLE) * 0.05e0 AS w, 0.1e0 + CAST(p % 4 AS DOUBLE) * 0.05e0 AS h, q / 50e0 AS confidence
FROM (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS mission_id, l_linenumber AS s, l_orderkey % 8 AS tick, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t, max(l_partkey) AS p, max(l_suppkey) AS k
      FROM {lineitem} GROUP BY 1, 2, 3) AS g""",
    # Ground-truth boxes near the tracks.
    "truth": """
SELECT mission_id, concat('g', CAST(s AS {BIGSTR})) AS gt_id, CAST(tick AS DOUBLE) * 0.5e0 AS t_sec, CASE s % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'box' END AS label,
       d * 5e0 + 0.01e0 AS x, t * 5e0 AS y, 0.1e0 + CAST(p % 5 AS DOUBLE) * 0.05e0 AS w, 0.1e0 + CAST((p + 1) % 4 AS DOUBLE) * 0.05e0 AS h, q * 0.2e0 + 0.1e0 AS cx, d * 50e0 AS cy, t * 25e0 AS cz,
       1.05e0 + CAST(p % 9 AS DOUBLE) * 0.5e0 AS depth_m
FROM (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS mission_id, l_linenumber AS s, l_orderkey % 8 AS tick, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t, max(l_partkey) AS p, max(l_suppkey) AS k
      FROM {lineitem} WHERE l_partkey % 10 <> 3 GROUP BY 1, 2, 3) AS g""",
    # Relation edges with intervals.
    "edges": """
SELECT o_orderkey AS edge_id, CAST(o_custkey AS BIGINT) AS mission_id, concat('s', CAST(o_orderkey % 4 AS {BIGSTR})) AS subject_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'left_of' WHEN '2-HIGH' THEN 'right_of' WHEN '3-MEDIUM' THEN 'above' WHEN '4-NOT SPECIFIED' THEN 'below' ELSE 'contains' END AS predicate,
       concat('s', CAST(4 + o_orderkey % 3 AS {BIGSTR})) AS object_id, CAST(o_orderkey % 60 AS DOUBLE) * 0.5e0 AS start_sec, CAST(o_orderkey % 60 AS DOUBLE) * 0.5e0 + 1e0 + CAST(o_orderkey % 9 AS DOUBLE) * 0.5e0 AS end_sec,
       CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'uncertain' END AS status, CAST(o_orderkey % 3 AS BIGINT) AS n_evidence,
       CASE WHEN o_orderkey % 5 = 1 THEN 'end' ELSE 'add' END AS op, CASE WHEN o_orderkey % 6 = 5 THEN o_orderkey - 1 ELSE NULL END AS supersedes, o_totalprice AS score
FROM {orders}""",
    # Claims with chains of replacements.
    "proposals": """
SELECT o_orderkey AS proposal_id, CAST(floor(o_orderkey / 20) AS BIGINT) AS mission_id, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'uncertain' END AS status,
       CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 7 = 3 THEN NULL ELSE o_orderkey - 1 END AS supersedes, CASE o_orderkey % 3 WHEN 0 THEN 'count' WHEN 1 THEN 'geometry' ELSE 'action' END AS claim_kind,
       CAST(o_orderkey % 60 AS DOUBLE) * 0.5e0 AS start_sec, CAST(o_orderkey % 60 AS DOUBLE) * 0.5e0 + 2e0 AS end_sec, concat('s', CAST(o_orderkey % 4 AS {BIGSTR})) AS subject_id
FROM {orders}""",
    # Background jobs with their progress.
    "jobs": """
SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'supervised_finetune' WHEN 1 THEN 'reembed' ELSE 'index' END AS type, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status,
       CASE o_orderkey % 3 WHEN 0 THEN '{{"accepted": true}}' WHEN 1 THEN '{{"accepted": false}}' ELSE NULL END AS progress
FROM {orders}""",
    # Detected events of missions.
    "timeline": """
SELECT o_orderkey AS event_id, CAST(o_custkey AS BIGINT) AS mission_id, CASE o_orderkey % 4 WHEN 0 THEN 'entered_region' WHEN 1 THEN 'left_region' WHEN 2 THEN 'approached' ELSE 'count_changed' END AS type,
       CAST(o_orderkey % 50 AS DOUBLE) AS start_sec, CAST(o_orderkey % 50 AS DOUBLE) + 1e0 + CAST(o_orderkey % 7 AS DOUBLE) AS end_sec, concat('s', CAST(o_orderkey % 5 AS {BIGSTR})) AS participant,
       CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'uncertain' END AS status, CAST(o_orderkey % 3 AS BIGINT) AS n_evidence, o_totalprice / 1e6 AS confidence
FROM {orders}""",
    # Tables of mission bundles, with some references that nothing answers and some ids that repeat.
    "b_observations": """
SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS mission_id, concat('o', CAST(l_orderkey % 40 AS {BIGSTR}), '-', CAST(l_linenumber AS {BIGSTR})) AS observation_id, concat('s', CAST(l_linenumber AS {BIGSTR})) AS track_id,
       CASE WHEN l_partkey % 9 = 0 THEN concat('s', CAST(l_linenumber % 4 + 5 AS {BIGSTR})) ELSE NULL END AS linked_track_id, CASE WHEN l_partkey % 11 = 0 THEN concat('o', CAST(l_orderkey % 40 AS {BIGSTR}), '-', CAST(l_linenumber % 5 AS {BIGSTR})) ELSE NULL END AS supersedes
FROM {lineitem}""",
    "b_nodes": """
SELECT DISTINCT CAST(floor(l_orderkey / 40) AS BIGINT) AS mission_id, concat('dn', CAST(l_linenumber AS {BIGSTR})) AS delta_id, CASE WHEN l_linenumber % 3 = 0 THEN concat('dn', CAST(l_linenumber + 2 AS {BIGSTR})) ELSE NULL END AS supersedes,
       concat('s', CAST(l_linenumber AS {BIGSTR})) AS node_id, concat('s', CAST(l_linenumber % 7 + 1 AS {BIGSTR})) AS track_id
FROM {lineitem} WHERE l_linenumber < 7""",
    "b_edges": """
SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS mission_id, concat('de', CAST(o_orderkey % 38 AS {BIGSTR})) AS delta_id, CASE WHEN o_orderkey % 6 = 0 THEN concat('de', CAST(o_orderkey % 41 AS {BIGSTR})) ELSE NULL END AS delta_supersedes, concat('e', CAST(o_orderkey % 39 AS {BIGSTR})) AS edge_id,
       concat('s', CAST(o_orderkey % 4 + 1 AS {BIGSTR})) AS subject_id, concat('s', CAST(o_orderkey % 8 AS {BIGSTR})) AS object_id, CASE WHEN o_orderkey % 5 = 0 THEN concat('e', CAST(o_orderkey % 43 AS {BIGSTR})) ELSE NULL END AS supersedes,
       split(concat('o', CAST(o_orderkey % 40 AS {BIGSTR}), '-', CAST(o_custkey % 5 AS {BIGSTR}), ',g', CAST(o_orderkey % 45 AS {BIGSTR})), ',') AS evidence_ids
FROM {orders}""",
    "b_samples": "SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS mission_id, concat('g', CAST(o_orderkey % 40 AS {BIGSTR})) AS sample_id FROM {orders}",
    "b_proposals": """
SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS mission_id, concat('p', CAST(o_orderkey % 39 AS {BIGSTR})) AS proposal_id, CASE WHEN o_orderkey % 4 = 0 THEN concat('p', CAST(o_orderkey % 44 AS {BIGSTR})) ELSE NULL END AS supersedes FROM {orders}""",
    "b_events": """
SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS mission_id, concat('v', CAST(o_orderkey % 39 AS {BIGSTR})) AS event_id, CASE WHEN o_orderkey % 7 = 0 THEN concat('v', CAST(o_orderkey % 47 AS {BIGSTR})) ELSE NULL END AS supersedes,
       split(concat('s', CAST(o_custkey % 8 AS {BIGSTR}), ',s', CAST(o_orderkey % 6 + 1 AS {BIGSTR})), ',') AS participants, split(concat('de', CAST(o_custkey % 41 AS {BIGSTR}), ',dn', CAST(o_custkey % 9 AS {BIGSTR})), ',') AS delta_refs,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('p', CAST(o_custkey % 42 AS {BIGSTR})) ELSE NULL END AS claim_ref, split(concat('s', CAST(o_custkey % 9 AS {BIGSTR})), ',') AS evidence_tracks, split(concat('geometry/g', CAST(o_custkey % 50 AS {BIGSTR})), ',') AS evidence_files
FROM {orders}""",
    "b_qa": "SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS mission_id, concat('q', CAST(o_orderkey % 40 AS {BIGSTR})) AS qa_id, CAST(o_custkey % 10 AS {BIGSTR}) AS answer FROM {orders} WHERE o_orderkey % 9 <> 0",
    "b_timeline_qa": """
SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS mission_id, concat('q', CAST(o_orderkey % 40 AS {BIGSTR})) AS qa_id, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 11 ELSE o_custkey % 10 END AS {BIGSTR}) AS answer, split(concat('v', CAST(o_custkey % 41 AS {BIGSTR})), ',') AS evidence_event_ids FROM {orders} WHERE o_orderkey % 10 <> 0""",
    "b_masks": "SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS mission_id, concat('s', CAST(o_custkey % 9 AS {BIGSTR})) AS track_id FROM {orders}",
    "b_files": "SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS mission_id, concat('geometry/g', CAST(o_orderkey % 40 AS {BIGSTR})) AS path FROM {orders}",
    # Frame quality signals in order of time.
    "signals": """
SELECT CAST(user_id % 25 AS BIGINT) AS mission_id, event_id AS frame_id, CAST({EPOCH_US}(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1e6 - 1704067200e0 AS t_sec, value AS drift, event_type <> 'error' AS good, event_type = 'signup' AS cut FROM {events}""",
}


def tables_of(text: str) -> list[str]:
    """Given tables that a domain table reads."""
    return [t for t in ("events", "customer", "supplier", "embeddings", "lineitem", "orders") if f"{{{t}}}" in text]


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame."""
    text = DOMAIN[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)}
    for word, (ours, _) in DIALECT.items():
        text = text.replace(f"{{{word}}}", ours)
    return spark.sql(text, **tables)


def domain_sql(*names: str) -> str:
    """The WITH clause of these domain tables in DuckDB."""
    words = {k: v[1] for k, v in DIALECT.items()}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({DOMAIN[n].format(**words, **{t: t for t in tables_of(DOMAIN[n])})})" for n in names)
