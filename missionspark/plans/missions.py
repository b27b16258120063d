"""Queries of joins, intervals, logs and quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles as B
from ..operators import identities as I
from ..operators import intervals as W
from ..operators import joins as J
from ..operators import logs as G
from ..operators import metrics as M
from .registry import query

IOU = """CASE WHEN {a}.w * {a}.h + {b}.w * {b}.h - {i} > 0 THEN {i} / ({a}.w * {a}.h + {b}.w * {b}.h - {i}) ELSE 0 END"""
INTER = "(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


def iou(a: str, b: str) -> str:
    return IOU.format(a=a, b=b, i=INTER.format(a=a, b=b))


TIOU = "(greatest(0, least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec)) / (greatest(a.end_sec, b.end_sec) - least(a.start_sec, b.start_sec)))"

#: Predicates that hold at one time between samples a and b.
RELATIONS = """
, pairs AS (SELECT a.mission_id, a.t_sec AS at_sec, a.subject_id AS l, b.subject_id AS r, a.sample_id, a.cx AS ax, a.cz AS az, b.cx AS bx, b.cz AS bz, a.depth_m AS ad, b.depth_m AS bd,
    a.subject_id < b.subject_id AS once, a.metric_scale = 'metric' AND b.metric_scale = 'metric' AS metric,
    sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz)) AS dist,
    a.cx - a.ex / 2 <= b.cx + b.ex / 2 AND b.cx - b.ex / 2 <= a.cx + a.ex / 2 AND a.cy - a.ey / 2 <= b.cy + b.ey / 2 AND b.cy - b.ey / 2 <= a.cy + a.ey / 2 AS over_xy,
    a.cz - a.ez / 2 <= b.cz + b.ez / 2 AND b.cz - b.ez / 2 <= a.cz + a.ez / 2 AS over_z,
    a.cx - a.ex / 2 <= b.cx - b.ex / 2 AND b.cx + b.ex / 2 <= a.cx + a.ex / 2 AND a.cy - a.ey / 2 <= b.cy - b.ey / 2 AND b.cy + b.ey / 2 <= a.cy + a.ey / 2 AND a.cz - a.ez / 2 <= b.cz - b.ez / 2 AND b.cz + b.ez / 2 <= a.cz + a.ez / 2 AS inside,
    abs(b.cz - b.ez / 2 - (a.cz + a.ez / 2)) <= 0.05 AS touch
  FROM geometry a JOIN geometry b ON a.mission_id = b.mission_id AND a.t_sec = b.t_sec AND a.subject_id <> b.subject_id),
rel AS (
  SELECT mission_id, at_sec, l, r, sample_id, 'contains' AS predicate, '' AS band FROM pairs WHERE inside
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'intersects', '' FROM pairs WHERE once AND over_xy AND over_z
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'left_of', '' FROM pairs WHERE ax + 0.05e0 < bx
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'right_of', '' FROM pairs WHERE ax > bx + 0.05e0
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'above', '' FROM pairs WHERE az > bz + 0.05e0
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'below', '' FROM pairs WHERE az + 0.05e0 < bz
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'supports', '' FROM pairs WHERE metric AND over_xy AND touch
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'contacts', '' FROM pairs WHERE once AND metric AND over_xy AND touch
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'occludes', '' FROM pairs WHERE ad + 0.05e0 < bd AND over_xy
  UNION ALL SELECT mission_id, at_sec, l, r, sample_id, 'distance_band', CASE WHEN dist <= 2 THEN '0.000-2.000' WHEN dist <= 8 THEN '2.000-8.000' ELSE '8.000-32.000' END FROM pairs WHERE once AND metric AND dist <= 32)"""


@query("j1_cotime_pairs", ["geometry"], " SELECT a.sample_id AS l_sample_id, b.sample_id AS r_sample_id FROM geometry a JOIN geometry b ON a.mission_id = b.mission_id AND round_even(a.t_sec, 6) = round_even(b.t_sec, 6) AND a.subject_id <> b.subject_id")
def j1(t):
    return J.cotime_pairs(t("geometry")).select("l_sample_id", "r_sample_id")


#: With what is visible from regions: 's1', which is no track here, and 's2' of some missions.
SEEN = RELATIONS[:-1] + """
  UNION ALL SELECT p.mission_id, at_sec, l, r, sample_id, 'visible', '' FROM pairs p JOIN (SELECT DISTINCT mission_id, track_id, round_even(t_sec, 6) AS t FROM tracks WHERE state IN ('tentative', 'confirmed', 'occluded') AND track_id <> 's1') k ON k.mission_id = p.mission_id AND k.track_id = l AND k.t = round_even(at_sec, 6)
    WHERE r = 's1' OR r = 's2' AND p.mission_id % 3 = 0)"""


def _looks(t):
    return t("tracks").filter("track_id <> 's1'"), t("tracks").filter("mission_id % 3 = 0").select("mission_id", F.lit("s2").alias("region_id"))


@query("j2_relations", ["geometry", "tracks"], SEEN + " SELECT mission_id, at_sec, l AS subject_id, predicate, r AS object_id, band FROM rel")
def j2(t):
    return W.relations(t("geometry"), *_looks(t)).select("mission_id", F.col("at").alias("at_sec"), F.col("l_subject_id").alias("subject_id"), "predicate", F.col("r_subject_id").alias("object_id"), "band")


@query("w2_relation_intervals", ["geometry", "tracks"], SEEN + """
, ticks AS (SELECT mission_id, l, r, at_sec, row_number() OVER w AS tick, lead(at_sec) OVER w AS next_at FROM (SELECT DISTINCT mission_id, l, r, at_sec FROM pairs) WINDOW w AS (PARTITION BY mission_id, l, r ORDER BY at_sec)),
held AS (SELECT rel.*, tick, next_at, tick - row_number() OVER (PARTITION BY rel.mission_id, rel.l, rel.r, predicate, band ORDER BY tick) AS run FROM rel JOIN ticks ON rel.mission_id = ticks.mission_id AND rel.l = ticks.l AND rel.r = ticks.r AND rel.at_sec = ticks.at_sec)
SELECT mission_id, l AS subject_id, predicate, r AS object_id, band, min(at_sec) AS start_sec, coalesce(arg_max_null(next_at, at_sec), max(at_sec) + 1) AS end_sec, arg_max(sample_id, at_sec) AS evidence_id
FROM held GROUP BY mission_id, l, r, predicate, band, run""")
def w2(t):
    return W.relation_intervals(t("geometry"), *_looks(t))


@query("v2_edge_ids", ["geometry", "tracks"], SEEN + """
, ticks AS (SELECT mission_id, l, r, at_sec, row_number() OVER w AS tick FROM (SELECT DISTINCT mission_id, l, r, at_sec FROM pairs) WINDOW w AS (PARTITION BY mission_id, l, r ORDER BY at_sec)),
held AS (SELECT rel.*, tick - row_number() OVER (PARTITION BY rel.mission_id, rel.l, rel.r, predicate, band ORDER BY tick) AS run FROM rel JOIN ticks ON rel.mission_id = ticks.mission_id AND rel.l = ticks.l AND rel.r = ticks.r AND rel.at_sec = ticks.at_sec)
SELECT mission_id, concat('edge-', predicate, '-', l, '-', r, '-', lpad(CAST(CAST(round_even(min(at_sec) * 1000, 0) AS BIGINT) AS VARCHAR), 7, '0')) AS edge_id, arg_max(sample_id, at_sec) AS evidence_id
FROM held GROUP BY mission_id, l, r, predicate, band, run""")
def v2(t):
    from ..operators.graph import edge_deltas

    return edge_deltas(t("geometry"), False, *_looks(t)).select("mission_id", "edge_id", "evidence_id")


@query("w6_motion_edges", ["geometry"], """
, e AS (SELECT mission_id, subject_id, min(t_sec) AS start_sec, max(t_sec) + 1 AS end_sec, arg_min(cx, t_sec) AS x0, arg_min(cy, t_sec) AS y0, arg_min(cz, t_sec) AS z0, arg_max(cx, t_sec) AS x1, arg_max(cy, t_sec) AS y1, arg_max(cz, t_sec) AS z1, count(*) AS n FROM geometry GROUP BY ALL),
m AS (SELECT *, sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1) + (z0 - z1) * (z0 - z1)) AS moved_m FROM e WHERE n >= 2)
SELECT m.mission_id, m.subject_id, min(g.subject_id) AS object_id, m.start_sec, m.end_sec, round(m.moved_m, 6) AS moved_m FROM m JOIN geometry g ON g.mission_id = m.mission_id AND g.subject_id <> m.subject_id AND g.t_sec >= m.start_sec AND g.t_sec < m.end_sec
WHERE m.moved_m > 0.05 GROUP BY m.mission_id, m.subject_id, m.start_sec, m.end_sec, m.moved_m""")
def w6(t):
    return W.motion_edges(t("geometry"), with_evidence=False).select("mission_id", "subject_id", "object_id", "start_sec", "end_sec", F.round("moved_m", 6).alias("moved_m"))


@query("w3_infeasible", ["geometry"], """
, s AS (SELECT mission_id, subject_id, metric_scale, t_sec - lag(t_sec) OVER w AS dt, sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w) + (cz - lag(cz) OVER w) * (cz - lag(cz) OVER w)) AS step
  FROM geometry WINDOW w AS (PARTITION BY mission_id, subject_id ORDER BY t_sec, sample_id))
SELECT mission_id, subject_id, count(*) FILTER (WHERE dt IS NOT NULL AND (dt <= 0 OR step > 8 * dt)) AS bad_steps FROM s GROUP BY ALL HAVING bool_and(metric_scale = 'metric') AND count(*) FILTER (WHERE dt IS NOT NULL AND (dt <= 0 OR step > 8 * dt)) > 0""")
def w3(t):
    return W.infeasible(t("geometry"), 8.0)


@query("w4_dynamic", ["tracks"], """
, s AS (SELECT mission_id, track_id, t_sec - lag(t_sec) OVER w AS dt, sqrt(pow(x + w / 2 - lag(x + w / 2) OVER w, 2) + pow(y + h / 2 - lag(y + h / 2) OVER w, 2)) AS d FROM tracks WINDOW w AS (PARTITION BY mission_id, track_id ORDER BY t_sec))
SELECT mission_id, track_id, round(coalesce(max(d / dt) FILTER (WHERE dt > 0), 0), 6) AS speed, coalesce(max(d / dt) FILTER (WHERE dt > 0), 0) > 0.3 AS dynamic FROM s GROUP BY ALL""")
def w4(t):
    return W.dynamic(t("tracks"), 0.3).select("mission_id", "track_id", F.round("speed", 6).alias("speed"), "dynamic")


@query("w5_count_changes", ["tracks"], """
, a AS (SELECT mission_id, label, round_even(t_sec, 6) AS at_sec, list_sort(list(DISTINCT track_id)) AS ids FROM tracks WHERE state IN ('tentative', 'confirmed', 'occluded') GROUP BY ALL),
g AS (SELECT l.mission_id, l.label, x.at_sec FROM (SELECT DISTINCT mission_id, label FROM a) l JOIN (SELECT DISTINCT mission_id, at_sec FROM a) x USING (mission_id)),
d AS (SELECT g.*, coalesce(ids, []) AS ids, lag(coalesce(ids, []), 1, []) OVER (PARTITION BY g.mission_id, g.label ORDER BY g.at_sec) AS before FROM g LEFT JOIN a USING (mission_id, label, at_sec))
SELECT mission_id, label, at_sec, array_to_string(ids, ',') AS ids, CAST(len(ids) AS INTEGER) AS n FROM d WHERE ids <> before AND len(ids) > 0""")
def w5(t):
    return W.count_changes(t("tracks")).select("mission_id", "label", F.col("at").alias("at_sec"), F.array_join("ids", ",").alias("ids"), "n")


@query("w7_quality_gaps", ["signals"], """
, s AS (SELECT *, lead(t_sec) OVER w AS next_t, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER w AS run FROM signals WINDOW w AS (PARTITION BY mission_id ORDER BY t_sec, frame_id))
SELECT mission_id, min(t_sec) AS start_sec, coalesce(arg_max_null(next_t, t_sec), max(t_sec)) AS end_sec, count(*) AS n FROM s WHERE NOT good GROUP BY mission_id, run""")
def w7(t):
    return W.quality_gaps(t("signals"))


@query("w8_replay_stamp", ["packets"], """
, e AS (SELECT packet_id, session_id, t_device AS event_time, CASE WHEN value > 25 THEN 'threat' ELSE 'sensor' END AS kind, packet_id % 7 AS sector, sensor_type FROM packets),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_time, kind, sector, sensor_type, packet_id) - 1 AS place FROM e)
SELECT packet_id, place, round(greatest(1704500000e0 + 0.25e0 * place, event_time) + CASE kind WHEN 'threat' THEN 0.4e0 ELSE 0 END + CASE sensor_type WHEN 'camera' THEN 0.3e0 WHEN 'gps' THEN 0.1e0 ELSE 0 END - event_time, 4) AS freshness_sec FROM p""")
def w8(t):
    kind = F.when(F.col("value") > 25, "threat").otherwise("sensor")
    rows = t("packets").select(F.col("packet_id").alias("event_id"), "session_id", F.col("t_device").alias("event_time"), kind.alias("event_kind"), (F.col("packet_id") % 7).alias("sector_id"), "sensor_type")
    out = W.replay_stamp(rows, ["session_id"], F.lit(1704500000.0), {"threat": 0.4, "camera": 0.3, "gps": 0.1})
    return out.select(F.col("event_id").alias("packet_id"), F.col("place").cast("bigint").alias("place"), F.round("freshness_sec", 4).alias("freshness_sec"))


@query("w9_check_monotonic", ["packets"], """
, s AS (SELECT session_id, packet_id, t_device % 600 AS t_sec, lag(t_device % 600) OVER (PARTITION BY session_id ORDER BY packet_id) AS before FROM packets)
SELECT session_id, packet_id, round(t_sec, 4) AS t_sec, round(before, 4) AS before FROM s WHERE t_sec < before""")
def w9(t):
    rows = t("packets").select("session_id", "packet_id", (F.col("t_device") % 600).alias("t_sec"))
    return W.check_monotonic(rows, ["session_id"], "packet_id").select("session_id", "packet_id", F.round("t_sec", 4).alias("t_sec"), F.round("before", 4).alias("before"))


@query("w12_motion_in", ["edges", "geometry"], """
, m AS (SELECT e.edge_id, g.* FROM edges e JOIN geometry g ON e.mission_id = g.mission_id AND e.subject_id = g.subject_id AND g.t_sec >= e.start_sec AND g.t_sec < e.end_sec)
SELECT edge_id, count(*) AS n, round(sqrt(pow(arg_min(cx, t_sec) - arg_max(cx, t_sec), 2) + pow(arg_min(cy, t_sec) - arg_max(cy, t_sec), 2) + pow(arg_min(cz, t_sec) - arg_max(cz, t_sec), 2)), 6) AS moved_m FROM m GROUP BY edge_id""")
def w12(t):
    return W_motion(t).select("edge_id", "n", F.round("moved_m", 6).alias("moved_m"))


def W_motion(t):
    return J.motion_in(t("edges"), t("geometry"), ["mission_id", "subject_id"], "edge_id")


@query("j3_last_in_interval", ["edges", "geometry"], """
SELECT e.edge_id, max(g.t_sec) AS last_t, arg_max(g.sample_id, g.t_sec) AS last_id FROM edges e LEFT JOIN geometry g ON e.mission_id = g.mission_id AND e.subject_id = g.subject_id AND g.t_sec >= e.start_sec AND g.t_sec < e.end_sec GROUP BY e.edge_id""")
def j3(t):
    return J.last_in_interval(t("edges"), t("geometry"), ["mission_id", "subject_id"], "edge_id", "sample_id")


@query("j4_nearest_in_time", ["frames", "packets"], """
, r AS (SELECT session_id % 25 AS mission_id, packet_id, (packet_id % 997) * 0.5e0 AS t_sec FROM packets),
c AS (SELECT f.frame_id, abs(f.t_sec - r.t_sec) AS off, r.t_sec, r.packet_id FROM frames f JOIN r ON f.mission_id = r.mission_id AND abs(f.t_sec - r.t_sec) <= 0.75)
SELECT frame_id, min(off) AS off, arg_min(packet_id, (off, t_sec, packet_id)) AS nearest_id FROM c GROUP BY frame_id""")
def j4(t):
    right = t("packets").select((F.col("session_id") % 25).alias("mission_id"), "packet_id", ((F.col("packet_id") % 997) * F.lit(0.5)).alias("t_sec"))
    return J.nearest_in_time(t("frames"), right, ["mission_id"], "frame_id", "packet_id", 0.75)


@query("j5_asof_state", ["tracks", "edges"], """
, q AS (SELECT edge_id AS query_id, mission_id, subject_id AS track_id, start_sec + 1e-6 AS t FROM edges)
SELECT q.query_id, t.state, t.label FROM q ASOF LEFT JOIN tracks t ON q.mission_id = t.mission_id AND q.track_id = t.track_id AND q.t >= t.t_sec""")
def j5(t):
    queries = t("edges").select(F.col("edge_id").alias("query_id"), "mission_id", F.col("subject_id").alias("track_id"), F.col("start_sec").alias("t_sec"))
    return J.asof(queries, t("tracks"), ["mission_id", "track_id"], ["state", "label"]).select("query_id", "state", "label")


@query("j6_overlaps", ["edges"], """
SELECT a.edge_id, b.edge_id AS other_id FROM edges a JOIN edges b ON a.mission_id = b.mission_id AND a.subject_id = b.subject_id AND a.status = 'accepted' AND b.status = 'accepted' AND a.predicate = 'left_of' AND b.predicate = 'right_of' AND a.start_sec < b.end_sec AND b.start_sec < a.end_sec""")
def j6(t):
    e = t("edges").filter("status = 'accepted'")
    return J.overlaps(e.filter("predicate = 'left_of'"), e.filter("predicate = 'right_of'"), ["mission_id", "subject_id"]).select("edge_id", F.col("r_edge_id").alias("other_id"))


@query("j6_supported_claims", ["proposals", "timeline"], """
, e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN replace(participant, 's', 'n') ELSE participant END AS who FROM timeline WHERE status = 'accepted' AND n_evidence > 0)
SELECT proposal_id FROM proposals p WHERE claim_kind = 'action' AND EXISTS (SELECT 1 FROM e WHERE e.mission_id = p.mission_id AND (e.who = p.subject_id OR e.who = replace(p.subject_id, 's', 'n') AND p.mission_id % 2 = 0) AND p.start_sec < e.end_sec AND e.start_sec < p.end_sec)""")
def j6_semi(t):
    who = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("participant", "s", "n")).otherwise(F.col("participant"))
    events = t("timeline").withColumn("participants", F.array(who, F.lit("other")))
    aliases = t("proposals").filter("mission_id % 2 = 0").select("mission_id", F.regexp_replace("subject_id", "s", "n").alias("node_id"), F.col("subject_id").alias("track_id")).distinct()
    claims = t("proposals").filter("claim_kind = 'action'").withColumnRenamed("proposal_id", "claim_id")
    return J.supported_claims(claims, events, aliases).withColumnRenamed("claim_id", "proposal_id")


@query("j7_superseded_events", ["timeline"], """
, d AS (SELECT * FROM timeline WHERE floor(event_id / 4) % 4 = 0), f AS (SELECT * FROM timeline WHERE floor(event_id / 4) % 4 <> 0),
c AS (SELECT d.event_id, f.event_id AS f, d.participant = f.participant AS shared, least(d.end_sec, f.end_sec) - greatest(d.start_sec, f.start_sec) AS o, abs(d.start_sec - f.start_sec) AS off FROM d JOIN f USING (mission_id, type)),
s AS (SELECT *, bool_or(shared) OVER (PARTITION BY event_id) AS any_shared FROM c),
k AS (SELECT * FROM s WHERE (shared OR NOT any_shared) AND (o > 0 OR shared)),
b AS (SELECT event_id, arg_min(f, (CASE WHEN o > 0 THEN -o ELSE 0 END, CASE WHEN o > 0 THEN 0 ELSE off END, f)) AS replaces FROM k GROUP BY 1)
SELECT d.event_id, b.replaces FROM d LEFT JOIN b USING (event_id)""")
def j7(t):
    deep = F.floor(F.col("event_id") / 4) % 4 == 0
    return J.superseded_events(t("timeline").filter(deep), t("timeline").filter(~deep))


@query("j8_link_profiles", ["tracks"], """
, f AS (SELECT mission_id, round_even(t_sec, 3) AS at, label, max(observation_id) AS replaces FROM tracks WHERE confidence < 0.5 GROUP BY ALL)
SELECT d.observation_id, f.replaces FROM tracks d LEFT JOIN f ON d.mission_id = f.mission_id AND round_even(d.t_sec, 3) = f.at AND d.label = f.label WHERE d.confidence >= 0.5""")
def j8(t):
    rows = t("tracks")
    return J.link_profiles(rows.filter("confidence < 0.5"), rows.filter("confidence >= 0.5")).select("observation_id", "replaces")


@query("j9_check_refs", ["edges", "timeline", "proposals", "geometry"], """
SELECT 'edge_subject' AS kind, concat(e.mission_id, '/', e.subject_id) AS id, count(*) AS n FROM edges e WHERE NOT EXISTS (SELECT 1 FROM geometry g WHERE g.mission_id = e.mission_id AND g.subject_id = e.subject_id) GROUP BY ALL
UNION ALL SELECT 'proposal_supersedes', CAST(p.supersedes - p.supersedes % 3 * 20000 AS VARCHAR), count(*) FROM proposals p WHERE p.supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM proposals q WHERE q.proposal_id = p.supersedes - p.supersedes % 3 * 20000) GROUP BY ALL""")
def j9(t):
    key = lambda df: df.withColumn("ref", F.concat_ws("/", "mission_id", "subject_id"))
    p = t("proposals")
    moved = p.withColumn("ref", F.col("supersedes") - F.col("supersedes") % 3 * 20000)
    return J.check_refs({"edge_subject": (key(t("edges")), "ref", key(t("geometry")).select("ref"), "ref"), "proposal_supersedes": (moved, "ref", p, "proposal_id")})


BUNDLE = ("observations", "nodes", "edges", "samples", "proposals", "events", "qa", "timeline_qa", "masks", "files")


def _bundle(t):
    return {name: t(f"b_{name}") for name in BUNDLE}


def _ref_sql(kind: str, table: str, column: str, known: str, many: bool = False) -> str:
    item = f"unnest({column})" if many else column
    return f"SELECT '{kind}' AS kind, concat(mission_id, '/', x) AS id, count(*) AS n FROM (SELECT mission_id, {item} AS x FROM b_{table}) WHERE x IS NOT NULL AND (mission_id, x) NOT IN (SELECT mission_id, x FROM ({known})) GROUP BY ALL"


def _known(*parts: tuple[str, str]) -> str:
    return " UNION ".join(f"SELECT mission_id, {column} AS x FROM b_{table} WHERE {column} IS NOT NULL" for table, column in parts)


TRACKS, DELTAS = _known(("observations", "track_id")), _known(("nodes", "delta_id"), ("edges", "delta_id"))


@query("j9_bundle_refs", [f"b_{name}" for name in BUNDLE], " " + " UNION ALL ".join([
    _ref_sql("identity_link", "observations", "linked_track_id", TRACKS), _ref_sql("track_supersedes", "observations", "supersedes", _known(("observations", "observation_id"))),
    _ref_sql("node_supersedes", "nodes", "supersedes", DELTAS), _ref_sql("delta_supersedes", "edges", "delta_supersedes", DELTAS), _ref_sql("node_track", "nodes", "track_id", TRACKS),
    _ref_sql("edge_subject", "edges", "subject_id", _known(("nodes", "node_id"))), _ref_sql("edge_object", "edges", "object_id", _known(("nodes", "node_id"))), _ref_sql("edge_supersedes", "edges", "supersedes", _known(("edges", "edge_id"))),
    _ref_sql("edge_evidence", "edges", "evidence_ids", _known(("observations", "observation_id"), ("samples", "sample_id")), True), _ref_sql("proposal_supersedes", "proposals", "supersedes", _known(("proposals", "proposal_id"))),
    _ref_sql("event_supersedes", "events", "supersedes", _known(("events", "event_id"))), _ref_sql("event_participant", "events", "participants", _known(("observations", "track_id"), ("nodes", "node_id")), True),
    _ref_sql("event_delta", "events", "delta_refs", DELTAS, True), _ref_sql("event_claim", "events", "claim_ref", _known(("proposals", "proposal_id"))), _ref_sql("event_evidence_track", "events", "evidence_tracks", TRACKS, True),
    _ref_sql("event_evidence_file", "events", "evidence_files", _known(("files", "path")), True), _ref_sql("qa_evidence", "timeline_qa", "evidence_event_ids", _known(("events", "event_id")), True), _ref_sql("mask_track", "masks", "track_id", TRACKS),
    "SELECT 'qa_log', concat(coalesce(q.mission_id, t.mission_id), '/', coalesce(q.qa_id, t.qa_id)) AS id, count(*) FROM b_qa q FULL JOIN b_timeline_qa t ON q.mission_id = t.mission_id AND q.qa_id = t.qa_id WHERE q.answer IS DISTINCT FROM t.answer GROUP BY ALL",
]))
def j9_bundle(t):
    return B.dangling(_bundle(t))


@query("g4_bundle_unique", [f"b_{name}" for name in BUNDLE], " SELECT kind, id, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, concat(mission_id, '/', {column}) AS id FROM b_{table}"
    for kind, table, column in [("observation_id", "observations", "observation_id"), ("delta_id", "nodes", "delta_id"), ("delta_id", "edges", "delta_id"), ("proposal_id", "proposals", "proposal_id"), ("event_id", "events", "event_id"), ("qa_id", "qa", "qa_id"),
                                ("timeline_qa_id", "timeline_qa", "qa_id"), ("node_id", "nodes", "node_id"), ("edge_id", "edges", "edge_id"), ("sample_id", "samples", "sample_id")]
) + ") GROUP BY ALL HAVING count(*) > 1")
def g4_bundle(t):
    # A line has an observation and at most a node with two ids, an order at most seven ids.
    return B.repeated(_bundle(t), 3 * t.raw("lineitem").count() + 7 * t.raw("orders").count())


@query("j11_assign_sites", ["missions", "sites"], """
, c AS (SELECT m.mission_id, s.site_id, sqrt(pow((m.lat - s.lat) * 111320e0, 2) + pow((m.lon - s.lon) * 111320e0 * cos(radians(s.lat)), 2)) AS off FROM missions m JOIN sites s ON abs(m.lat - s.lat) < 0.1 AND abs(m.lon - s.lon) < 0.2),
b AS (SELECT mission_id, min(off) AS off, arg_min(site_id, (off, site_id)) AS site_id FROM c WHERE off <= 5000 GROUP BY 1),
r AS (SELECT *, floor(lat / (5000e0 / 111320e0)) AS cell FROM missions),
w AS (SELECT *, greatest(floor(360e0 * cos(radians(least(greatest(abs((cell - 1) * (5000e0 / 111320e0)), abs((cell + 2) * (5000e0 / 111320e0))), 89.9e0))) / (5000e0 / 111320e0)), 1) AS n FROM r)
SELECT m.mission_id, coalesce(CAST(b.site_id AS VARCHAR), concat('new:', CAST(CAST(cell AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor((lon + 180e0) / 360e0 * n) AS BIGINT) % CAST(n AS BIGINT) AS VARCHAR))) AS site, round(b.off, 3) AS distance_m FROM w m LEFT JOIN b USING (mission_id)""")
def j11(t):
    return J.assign_sites(t("missions"), t("sites")).select("mission_id", "site", F.round("distance_m", 3).alias("distance_m"))


@query("j12_detect_changes", ["points"], """
, c AS (SELECT a.id, b.id AS r, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance FROM points a JOIN points b ON a.mission_id <> b.mission_id
  AND sqrt(pow((a.lat - b.lat) * 111320e0, 2) + pow((a.lon - b.lon) * 111320e0 * cos(radians(b.lat)), 2)) <= 400),
n AS (SELECT id, min(distance) AS distance, arg_min(r, (distance, r)) AS reference FROM c GROUP BY id)
SELECT id, reference, round(distance, 6) AS distance FROM n WHERE distance > 0.35""")
def j12(t):
    return J.detect_changes(t("points"), 400.0, 0.35).select("id", "reference", F.round("distance", 6).alias("distance"))


@query("j13_site_missions", ["missions", "sites"], " SELECT s.site_id, m.mission_id, m.robot_id FROM sites s JOIN missions m USING (site_id) WHERE m.status = 'done' ORDER BY 1, 2")
def j13(t):
    return t("sites").select("site_id").join(t("missions").filter("status = 'done'"), "site_id").select("site_id", "mission_id", "robot_id").orderBy("site_id", "mission_id")


@query("j15_subtitles", ["frames"], """
, s AS (SELECT CAST(conv_id % 25 AS BIGINT) AS mission_id, conv_id * 3e0 + turn AS start_sec, conv_id * 3e0 + turn + 0.8e0 AS end_sec, text FROM conversations)
SELECT f.frame_id, string_agg(s.text, ' ' ORDER BY s.start_sec, s.text) AS subtitle FROM frames f LEFT JOIN s ON f.mission_id = s.mission_id AND f.t_sec >= s.start_sec - 0.5 AND f.t_sec <= s.end_sec + 0.5 GROUP BY f.frame_id""")
def j15(t):
    at = F.col("conv_id") * F.lit(3.0) + F.col("turn")
    segments = t.raw("conversations").select((F.col("conv_id") % 25).alias("mission_id"), at.alias("start_sec"), (at + 0.8).alias("end_sec"), "text")
    return J.subtitles(t("frames"), segments, 0.5)


@query("j15_whole_subtitles", ["frames"], """
, s AS (SELECT CAST(conv_id % 25 AS BIGINT) AS mission_id, conv_id * 3e0 + turn AS start_sec, conv_id * 3e0 + turn + 0.8e0 AS end_sec, text FROM conversations)
SELECT f.frame_id, string_agg(s.text, ' ' ORDER BY s.start_sec, s.text) AS subtitle FROM frames f LEFT JOIN s ON f.mission_id = s.mission_id AND f.t_sec >= s.start_sec - 1.5 AND f.t_sec <= s.end_sec + 1.5 GROUP BY f.frame_id""")
def j15_whole(t):
    at = F.col("conv_id") * F.lit(3.0) + F.col("turn")
    segments = t.raw("conversations").select((F.col("conv_id") % 25).alias("mission_id"), at.alias("start_sec"), (at + 0.8).alias("end_sec"), "text")
    return J.subtitles(t("frames"), segments, 1.5)


@query("j16_label_masks", ["tracks", "truth"], f"""
, c AS (SELECT m.mission_id, m.gt_id, m.t_sec, round({iou('m', 'd')}, 9) AS v, d.label FROM truth m JOIN tracks d ON m.mission_id = d.mission_id AND m.t_sec = d.t_sec),
b AS (SELECT mission_id, gt_id, t_sec, max(v) AS v, arg_max(label, (v, label)) AS label FROM c GROUP BY ALL)
SELECT mission_id, gt_id AS mask_id, t_sec, CASE WHEN b.v >= 0.1 THEN b.label ELSE 'unlabeled' END AS label FROM truth LEFT JOIN b USING (mission_id, gt_id, t_sec)""")
def j16(t):
    return J.label_masks(t("truth").withColumnRenamed("gt_id", "mask_id").drop("label"), t("tracks"))


@query("j17_scene_overlap", ["missions"], """
, s AS (SELECT mission_id AS scene_id, (lat - 40) * 1000e0 AS x, (lon - 10) * 1000e0 AS y, 80e0 + CAST(mission_id % 7 AS DOUBLE) * 10e0 AS radius FROM missions)
SELECT a.scene_id, b.scene_id AS r_scene_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM s a JOIN s b ON a.scene_id < b.scene_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < a.radius + b.radius""")
def j17(t):
    scenes = t("missions").select(F.col("mission_id").alias("scene_id"), ((F.col("lat") - 40) * F.lit(1000.0)).alias("x"), ((F.col("lon") - 10) * F.lit(1000.0)).alias("y"), (F.lit(80.0) + (F.col("mission_id") % 7) * F.lit(10.0)).alias("radius"))
    return J.scene_overlap(scenes, 140.0).select("scene_id", "r_scene_id", F.round("distance", 6).alias("distance"))


@query("j18_apply_annotations", ["frames"], " SELECT frame_id, concat('label-', frame_id % 5) AS new_label FROM frames WHERE frame_id % 3 = 0 AND NOT (frame_id % 4 = 2)")
def j18(t):
    frames = t("frames").select("frame_id", F.concat(F.lit("/data/f/"), "frame_id", F.lit(".jpg")).alias("frame_path"), F.when(F.col("al_tag") == "annotated", F.lit("old")).alias("cvat_label"))
    labels = t("frames").filter("frame_id % 3 = 0").select(F.concat(F.lit("task/x/"), "frame_id", F.lit(".jpg")).alias("file"), F.concat(F.lit("label-"), F.col("frame_id") % 5).alias("label"))
    return J.apply_annotations(frames, labels)


@query("j12_facts_diff", ["points", "frames"], """
, c AS (SELECT a.id, b.id AS r, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance FROM points a JOIN points b ON a.mission_id <> b.mission_id
  AND sqrt(pow((a.lat - b.lat) * 111320e0, 2) + pow((a.lon - b.lon) * 111320e0 * cos(radians(b.lat)), 2)) <= 400),
n AS (SELECT id, min(distance) AS distance, arg_min(r, (distance, r)) AS reference FROM c GROUP BY id),
f AS (SELECT frame_id AS id, json_extract_string(facts, '$.road_condition') AS road, json_extract_string(facts, '$.vehicle_groups[0].count') AS cars FROM frames),
d AS (SELECT n.id, n.reference, unnest(['road_condition', 'cars']) AS key, unnest([t.road, t.cars]) AS was, unnest([f.road, f.cars]) AS "is" FROM n LEFT JOIN f ON f.id = n.id LEFT JOIN f t ON t.id = n.reference WHERE n.distance > 0.35)
SELECT id, reference, key, was, "is" FROM d WHERE was IS DISTINCT FROM "is" """)
def j12_facts(t):
    road, cars = F.get_json_object("facts", "$.road_condition"), F.get_json_object("facts", "$.vehicle_groups[0].count")
    facts = t("frames").filter("facts is not null").select(F.col("frame_id").alias("id"), F.create_map(F.lit("road_condition"), road, F.lit("cars"), cars).alias("facts"))
    return J.facts_diff(J.detect_changes(t("points"), 400.0, 0.35), facts)


@query("j19_evidence", ["timeline", "geometry", "tracks"], """
, e AS (SELECT event_id, mission_id, participant, start_sec % 4 AS start_sec FROM timeline),
f AS (SELECT e.event_id, g.sample_id, CAST(NULL AS VARCHAR) AS mask_id FROM e JOIN geometry g ON e.mission_id = g.mission_id AND e.participant = g.subject_id AND g.t_sec BETWEEN e.start_sec - 0.5 AND e.start_sec + 0.5
  UNION ALL SELECT e.event_id, NULL, k.observation_id FROM e JOIN tracks k ON e.mission_id = k.mission_id AND e.participant = k.track_id AND k.t_sec BETWEEN e.start_sec - 0.5 AND e.start_sec + 0.5)
SELECT e.event_id, f.sample_id, f.mask_id FROM e LEFT JOIN f USING (event_id)""")
def j19(t):
    return J.evidence(t("timeline").withColumn("start_sec", F.col("start_sec") % 4), t("geometry"), t("tracks").withColumnRenamed("observation_id", "mask_id"), 0.5)


@query("j19_answer_evidence", ["timeline", "geometry", "tracks"], """
, a AS (SELECT mission_id AS qa_id, unnest(list_slice(list_sort(list(event_id)), 1, 3)) AS event_id FROM timeline WHERE status = 'accepted' GROUP BY mission_id),
e AS (SELECT qa_id, event_id, mission_id, participant, start_sec % 4 AS start_sec FROM a JOIN timeline USING (event_id)),
f AS (SELECT e.event_id, g.sample_id, CAST(NULL AS VARCHAR) AS mask_id FROM e JOIN geometry g ON e.mission_id = g.mission_id AND e.participant = g.subject_id AND g.t_sec BETWEEN e.start_sec - 0.5 AND e.start_sec + 0.5
  UNION ALL SELECT e.event_id, NULL, k.observation_id FROM e JOIN tracks k ON e.mission_id = k.mission_id AND e.participant = k.track_id AND k.t_sec BETWEEN e.start_sec - 0.5 AND e.start_sec + 0.5)
SELECT e.qa_id, e.event_id, f.sample_id, f.mask_id FROM e LEFT JOIN f USING (event_id)""")
def j19_answers(t):
    events = t("timeline").withColumn("start_sec", F.col("start_sec") % 4)
    answers = events.filter("status = 'accepted'").groupBy(F.col("mission_id").alias("qa_id")).agg(F.slice(F.array_sort(F.collect_list("event_id")), 1, 3).alias("evidence_event_ids"))
    cited = J.answer_evidence(answers, events)
    found = J.evidence(cited, t("geometry"), t("tracks").withColumnRenamed("observation_id", "mask_id"), 0.5)
    return cited.select("qa_id", F.col("event_id").alias("of")).join(found, F.col("of") == F.col("event_id")).select("qa_id", "event_id", "sample_id", "mask_id")


@query("j20_precheck", [], """
WITH f AS (SELECT event_id AS file_id, CASE WHEN event_id % 5 < 2 THEN md5(event_type || CAST(user_id % 40 AS VARCHAR)) END AS digest, CASE WHEN event_id % 5 < 3 THEN concat('u', user_id % 60) END AS url, CASE WHEN event_id % 5 < 4 THEN CAST(user_id % 50 AS BIGINT) END AS size, ts FROM events),
p AS (SELECT event_id AS id, md5(event_type || CAST(user_id % 40 AS VARCHAR)) AS digest, concat('u', user_id % 60) AS url, CAST(user_id % 50 AS BIGINT) AS size, ts FROM events WHERE event_id % 60 = 0),
r AS (SELECT file_id, CASE WHEN digest IS NOT NULL THEN 'hash' WHEN url IS NOT NULL THEN 'url' WHEN size IS NOT NULL THEN 'size' ELSE 'hash_failed' END AS reason, digest, url, size FROM f WHERE file_id % 60 <> 0),
x AS (SELECT file_id, reason, CASE reason WHEN 'hash' THEN d.id WHEN 'url' THEN u.id WHEN 'size' THEN z.id END AS existing FROM r LEFT JOIN (SELECT digest, arg_max(id, (ts, id)) AS id FROM p GROUP BY 1) d USING (digest) LEFT JOIN (SELECT url, arg_max(id, (ts, id)) AS id FROM p GROUP BY 1) u USING (url) LEFT JOIN (SELECT size, arg_max(id, (ts, id)) AS id FROM p GROUP BY 1) z USING (size))
SELECT file_id, CASE WHEN reason = 'hash_failed' THEN 'error' WHEN existing IS NOT NULL THEN 'duplicate' ELSE 'new' END AS status, reason, existing FROM x""")
def j20(t):
    i, u = F.col("event_id"), F.col("user_id")
    digest, url, size = F.md5(F.concat("event_type", (u % 40).cast("string"))), F.concat(F.lit("u"), u % 60), (u % 50).cast("long")
    some = lambda c, below: F.when(i % 5 < below, c)
    files = t.raw("events").filter("event_id % 60 <> 0").select(i.alias("file_id"), some(digest, 2).alias("digest"), some(url, 3).alias("url"), some(size, 4).alias("size"))
    processed = t.raw("events").filter("event_id % 60 = 0").select(i.alias("id"), digest.alias("digest"), url.alias("url"), size.alias("size"), F.col("ts").alias("updated_at"))
    return J.precheck(files, processed)


@query("j21_link_identities", ["points"], """
, k AS (SELECT mission_id % 3 AS mission_id, id AS track_id, mission_id % 2 AS label, (id % 50) * 2e0 AS born, (id % 50) * 2e0 + 5 AS ended, embedding FROM points WHERE type = 'frame'),
r AS (SELECT DISTINCT mission_id % 3 AS mission_id, (id % 10) * 11e0 AS t_sec FROM points WHERE type = 'tile'),
c AS (SELECT a.mission_id, a.track_id, b.ended, b.track_id AS o, a.born - b.ended AS gap, EXISTS (SELECT 1 FROM r WHERE r.mission_id = a.mission_id AND r.t_sec > b.ended AND r.t_sec <= a.born) AS cut FROM k a JOIN k b ON a.mission_id = b.mission_id AND a.label = b.label AND a.track_id <> b.track_id AND b.ended <= a.born
  AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.2)
SELECT mission_id, track_id, arg_max(o, (ended, o)) AS linked, CASE WHEN arg_max(cut, (ended, o)) THEN 'camera_cut' ELSE 'occlusion' END AS reason FROM c WHERE cut OR gap >= 2 GROUP BY ALL""")
def j21(t):
    born = (F.col("id") % 50) * F.lit(2.0)
    tracks = t("points").filter("type = 'frame'").select((F.col("mission_id") % 3).alias("mission_id"), F.col("id").alias("track_id"), (F.col("mission_id") % 2).alias("label"), born.alias("born"), (born + 5).alias("ended"), F.col("embedding").alias("vector"))
    resets = t("points").filter("type = 'tile'").select((F.col("mission_id") % 3).alias("mission_id"), ((F.col("id") % 10) * F.lit(11.0)).alias("t_sec")).distinct()
    return I.link_identities(tracks, "vector", resets, 0.2)


@query("j22_georeference", ["tracks", "geometry"], """
, p AS (SELECT mission_id, t_sec, max(cx) AS east, max(cy) AS north FROM geometry WHERE subject_id = 's1' GROUP BY ALL)
SELECT o.observation_id, round(p.east + (least(1, greatest(0, o.x + o.w / 2)) - 0.5) * (o.confidence * 20), 6) AS east_m, round(p.north + (0.5 - least(1, greatest(0, o.y + o.h / 2))) * (o.confidence * 20), 6) AS north_m FROM tracks o ASOF LEFT JOIN p ON o.mission_id = p.mission_id AND o.t_sec + 1e-6 >= p.t_sec""")
def j22(t):
    poses = t("geometry").filter("subject_id = 's1'").groupBy("mission_id", "t_sec").agg(F.max("cx").alias("east"), F.max("cy").alias("north"))
    rows = J.georeference(t("tracks").withColumn("range_m", F.col("confidence") * 20), poses)
    return rows.select("observation_id", F.round("east_m", 6).alias("east_m"), F.round("north_m", 6).alias("north_m"))


@query("j23_region_samples", ["geometry"], """
, r AS (SELECT mission_id, subject_id AS region_id, arg_min(cx, sample_id) AS cx FROM geometry WHERE ex > 2.5 GROUP BY ALL), s AS (SELECT DISTINCT mission_id, t_sec FROM geometry)
SELECT mission_id, region_id, t_sec, cx FROM r JOIN s USING (mission_id)""")
def j23(t):
    g = t("geometry")
    regions = g.filter("ex > 2.5").select("mission_id", F.col("subject_id").alias("region_id"), F.col("sample_id").alias("line"), "cx", "cy", "cz")
    return J.region_samples(regions, g).select("mission_id", "region_id", "t_sec", "cx")


@query("j24_apply_poses", ["frames"], " SELECT frame_id, CASE WHEN frame_id % 4 = 1 THEN concat('new-', frame_id) WHEN frame_id % 3 = 0 THEN 'old' END AS pose FROM frames")
def j24(t):
    frames = t("frames").select("frame_id", F.when(F.col("frame_id") % 3 == 0, "old").alias("pose"))
    poses = frames.filter("frame_id % 4 = 1").select("frame_id", F.concat(F.lit("new-"), "frame_id").alias("pose"))
    return J.apply_poses(frames, poses)


@query("g1_materialise_graph", ["edges"], " SELECT edge_id, predicate FROM edges e WHERE op <> 'end' AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.supersedes = e.edge_id)")
def g1(t):
    return G.materialise_graph(t("edges")).select("edge_id", "predicate")


@query("g2_effective_status", ["proposals"], """
, c AS (SELECT supersedes AS parent, max(proposal_id) AS child FROM proposals WHERE supersedes IS NOT NULL GROUP BY 1),
walk AS (SELECT proposal_id, proposal_id AS last FROM proposals UNION ALL SELECT w.proposal_id, c.child FROM walk w JOIN c ON c.parent = w.last),
ends AS (SELECT proposal_id, last FROM walk WHERE last NOT IN (SELECT parent FROM c))
SELECT e.proposal_id, e.last AS effective_id, p.status AS effective_status FROM ends e JOIN proposals p ON p.proposal_id = e.last""")
def g2(t):
    return G.effective_status(t("proposals"))


@query("g3_check_cycles", ["proposals"], """
, p AS (SELECT proposal_id AS child, CASE WHEN proposal_id % 40 = 0 THEN proposal_id + 2 WHEN proposal_id % 40 = 25 THEN proposal_id + 13 WHEN proposal_id % 40 < 39 THEN proposal_id - 1 END AS parent FROM proposals),
k AS (SELECT child, parent FROM p WHERE parent IS NOT NULL AND parent IN (SELECT child FROM p)),
reach AS (SELECT child, parent FROM k UNION SELECT r.child, k.parent FROM reach r JOIN k ON k.child = r.parent)
SELECT child AS node FROM reach WHERE child = parent""")
def g3(t):
    i = F.col("proposal_id")
    parent = F.when(i % 40 == 0, i + 2).when(i % 40 == 25, i + 13).when(i % 40 < 39, i - 1)
    return G.check_cycles(t("proposals").select(i.alias("child"), parent.alias("parent")))


@query("g4_check_unique", [], """
SELECT 'line' AS kind, concat(l_orderkey, '/', l_linenumber) AS id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'order', CAST(o_custkey * 100 + o_orderkey % 7 AS VARCHAR), count(*) FROM orders GROUP BY ALL HAVING count(*) > 1""")
def g4(t):
    lines = t.raw("lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"))
    orders = t.raw("orders").select((F.col("o_custkey") * 100 + F.col("o_orderkey") % 7).alias("id"))
    return G.check_unique({"line": (lines, "id"), "order": (orders, "id")})


@query("g5_diff_ids", ["timeline"], """
, a AS (SELECT event_id FROM timeline WHERE status <> 'rejected'), b AS (SELECT event_id FROM timeline WHERE n_evidence > 0)
(SELECT event_id AS id, 'left' AS side FROM a EXCEPT SELECT event_id, 'left' FROM b) UNION ALL (SELECT event_id, 'right' FROM b EXCEPT SELECT event_id, 'right' FROM a)""")
def g5(t):
    e = t("timeline")
    return G.diff_ids(e.filter("status <> 'rejected'"), e.filter("n_evidence > 0"), "event_id")


@query("g6_union_kinds", ["packets", "timeline"], " SELECT 'sensor' AS event_kind, packet_id, NULL AS event_id, value, NULL AS type FROM packets UNION ALL SELECT 'scene', NULL, event_id, NULL, type FROM timeline")
def g6(t):
    both = G.union_kinds({"sensor": t("packets").select("packet_id", "value"), "scene": t("timeline").select("event_id", "type")})
    return both.select("event_kind", "packet_id", "event_id", "value", "type")


@query("g7_dedupe_files", [], """
WITH f AS (SELECT doc_id AS file_id, sha256(coalesce(text, '')) AS digest FROM documents), g AS (SELECT digest, min(file_id) AS file_id, count(*) AS copies FROM f GROUP BY digest)
SELECT * FROM g WHERE digest NOT IN (SELECT digest FROM f WHERE file_id % 9 = 0)""")
def g7(t):
    files = t.raw("documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("content"))
    processed = files.filter("file_id % 9 = 0").select(F.sha2("content", 256).alias("digest"))
    return G.dedupe_files(files, processed, "content")


@query("g8_hamming_pairs", ["points"], """
, h AS (SELECT id AS tile_id, CAST(list_sum(list_transform(range(48), lambda i: CASE WHEN embedding[CAST(i + 1 AS INTEGER)] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT) AS hash FROM points)
SELECT a.tile_id AS a, b.tile_id AS b, bit_count(xor(a.hash, b.hash)) AS distance FROM h a JOIN h b ON a.tile_id < b.tile_id AND bit_count(xor(a.hash, b.hash)) <= 6""")
def g8(t):
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(47)), F.lit(0).cast("bigint"), lambda s, i: s + F.when(F.get("embedding", i) > 0, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    tiles = t("points").select(F.col("id").alias("tile_id"), bits.alias("hash"))
    return G.hamming_pairs(tiles, 6, 48).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query("g8_dedupe_tiles", ["points"], """
, h AS (SELECT id AS tile_id, mission_id % 2 AS mission_id, CAST(list_sum(list_transform(range(48), lambda i: CASE WHEN embedding[CAST(i + 1 AS INTEGER)] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT) AS hash, embedding AS v, id % 20 AS cell, id // 100 AS win, (id * 37) % 101 AS score FROM points),
g AS (SELECT DISTINCT b.tile_id FROM h a JOIN h b ON a.tile_id < b.tile_id AND a.mission_id = b.mission_id AND bit_count(xor(a.hash, b.hash)) <= 12 AND list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) > 0.6),
l AS (SELECT *, row_number() OVER (PARTITION BY mission_id, cell, win ORDER BY score DESC, tile_id) AS best FROM h WHERE tile_id NOT IN (SELECT tile_id FROM g)),
r AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY score DESC, tile_id) AS place FROM l WHERE best = 1)
SELECT mission_id, tile_id, cell, win, score FROM r WHERE place <= 200""")
def g8_tiles(t):
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(47)), F.lit(0).cast("bigint"), lambda s, i: s + F.when(F.get("embedding", i) > 0, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    tiles = t("points").select(F.col("id").alias("tile_id"), (F.col("mission_id") % 2).alias("mission_id"), bits.alias("hash"), F.col("embedding").alias("vector"), (F.col("id") % 20).alias("cell"), F.floor(F.col("id") / 100).alias("window"), ((F.col("id") * 37) % 101).alias("score"))
    return G.dedupe_tiles(tiles, 12, 0.6, 200, 48).select("mission_id", "tile_id", "cell", F.col("window").alias("win"), "score")


@query("g9_check_identity", ["frames", "missions"], """
SELECT f.mission_id, CASE WHEN m.mission_id IS NULL THEN 'unknown_mission' ELSE 'other_robot_id' END AS code, count(*) AS n FROM (SELECT mission_id * 9 AS mission_id, concat('robot-', mission_id % 5) AS robot_id FROM frames) f
LEFT JOIN missions m ON m.mission_id = f.mission_id WHERE m.mission_id IS NULL OR m.robot_id <> f.robot_id GROUP BY ALL""")
def g9(t):
    rows = t("frames").select((F.col("mission_id") * 9).alias("mission_id"), F.concat(F.lit("robot-"), F.col("mission_id") % 5).alias("robot_id"))
    return G.check_identity(rows, t("missions"), ["robot_id"])


@query("s8_upsert", ["missions"], " SELECT mission_id, CASE WHEN mission_id % 3 = 0 THEN 'done' ELSE status END AS status FROM missions UNION ALL SELECT mission_id + 1000000, 'done' FROM missions WHERE mission_id % 3 = 1")
def s8(t):
    current = t("missions").select("mission_id", "status")
    new = current.filter("mission_id % 3 <> 2").select(F.when(F.col("mission_id") % 3 == 0, F.col("mission_id")).otherwise(F.col("mission_id") + 1000000).alias("mission_id"), F.lit("done").alias("status"))
    return G.latest_wins(current, new, ["mission_id"])


@query("s11_export_vectors", ["points"], " SELECT id, mission_id, lat, coalesce(tx, 'NaN'::DOUBLE) AS tx, len(embedding) AS dim FROM points WHERE type = 'frame' AND mission_id IN (1, 2, 3) AND lat BETWEEN 52 AND 52.02 AND lon BETWEEN 13 AND 13.03")
def s11(t):
    return G.export_vectors(t("points"), [1, 2, 3], (52.0, 52.02, 13.0, 13.03)).select("id", "mission_id", "lat", "tx", F.size("embedding").cast("bigint").alias("dim"))


@query("s12_unpublished", ["timeline"], " SELECT event_id, type FROM timeline WHERE status = 'accepted' AND n_evidence > 0 AND event_id % 3 <> 0")
def s12(t):
    return G.unpublished(t("timeline"), t("timeline").filter("event_id % 3 = 0").select("event_id")).select("event_id", "type")


@query("s7_supersede", ["missions"], " SELECT mission_id, digest, 2 AS version FROM (SELECT mission_id, md5(concat('new', mission_id)) AS digest FROM missions WHERE mission_id % 2 = 0)")
def s7(t):
    versions = t("missions").select("mission_id", F.lit(1).alias("version"), F.md5(F.concat(F.lit("v"), "mission_id")).alias("digest"))
    new = versions.select("mission_id", F.md5(F.concat(F.lit("new"), "mission_id")).alias("digest"), F.when(F.col("mission_id") % 2 == 0, F.col("digest")).otherwise(F.lit("stale")).alias("supersedes_digest"))
    return G.supersede(versions, new, "mission_id")[0].select("mission_id", "digest", "version")


@query("m1_coverage", ["signals"], """
, k AS (SELECT mission_id, t_sec % 500 AS t_sec FROM signals WHERE good AND frame_id % 5 = 0), b AS (SELECT mission_id, t_sec % 500 AS t_sec FROM signals WHERE cut)
SELECT mission_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.mission_id = b.mission_id AND abs(k.t_sec - b.t_sec) <= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM b GROUP BY mission_id""")
def m1(t):
    s = t("signals").withColumn("t_sec", F.col("t_sec") % 500)
    return M.coverage(s.filter("cut"), s.filter("good and frame_id % 5 = 0"))


PAIRS = f"""
, pred AS (SELECT * FROM tracks WHERE state IN ('tentative', 'confirmed')),
c AS (SELECT p.mission_id, p.t_sec, p.track_id, g.gt_id, round({iou('p', 'g')}, 9) AS v FROM pred p JOIN truth g ON p.mission_id = g.mission_id AND p.t_sec = g.t_sec)"""


@query("m2_frame_matches", [], None)
def m2(t):
    return M.frame_matches(t("tracks").filter(M.ACTIVE), t("truth")).select("mission_id", "t_sec", "track_id", "gt_id", F.round("iou", 6).alias("iou"))


@query("m2_candidate_pairs", ["tracks", "truth"], PAIRS + " SELECT mission_id, t_sec, count(*) AS n FROM c WHERE v >= 0.5 GROUP BY ALL")
def m2_pairs(t):
    from ..functions.exprs import iou_2d

    box = lambda p: tuple(F.col(f"{p}{c}") for c in "xywh")
    met = t("tracks").filter(M.ACTIVE).join(J.prefixed(t("truth"), "g_"), (F.col("mission_id") == F.col("g_mission_id")) & (F.col("t_sec") == F.col("g_t_sec")))
    return met.filter(F.round(iou_2d(box(""), box("g_")), 9) >= 0.5).groupBy("mission_id", "t_sec").agg(F.count("*").alias("n"))


@query("m3_grounding", [], None)
def m3(t):
    return M.grounding(t("tracks").filter(M.ACTIVE), t("truth"))


@query("m4_tracking_quality", [], None)
def m4(t):
    return M.tracking_quality(t("tracks").filter(M.ACTIVE), t("truth"))


@query("m5_count_mae", ["tracks", "truth"], """
, c AS (SELECT mission_id, t_sec, label, count(*) AS n FROM truth GROUP BY ALL), a AS (SELECT mission_id, t_sec, label, count(*) AS n FROM tracks WHERE state IN ('tentative', 'confirmed') GROUP BY ALL)
SELECT mission_id, round(avg(abs(coalesce(a.n, 0) - c.n)), 6) AS mae FROM c LEFT JOIN a USING (mission_id, t_sec, label) GROUP BY mission_id""")
def m5(t):
    return M.count_mae(t("tracks"), t("truth").groupBy("mission_id", "t_sec", "label").agg(F.count("*").alias("count")))


def _bit_sql(place: str, seed: int) -> str:
    return f"((o_orderkey * 7 + ({place}) * ({place}) + {seed}) % 5 < 3)"


def _edge_sql(seed: int) -> str:
    inner = " AND ".join(f"{inside} AND {_bit_sql(place, seed)}" for inside, place in (("i % 6 < 5", "i + 1"), ("i % 6 > 0", "i - 1"), ("i // 6 < 5", "i + 6"), ("i // 6 > 0", "i - 6")))
    return f"({_bit_sql('i', seed)} AND NOT ({inner}))"


@query("m6_mask_quality", [], f"""
WITH b AS (SELECT CAST(o_custkey AS BIGINT) AS mission_id, o_orderkey AS mask_id, {_bit_sql('i', 0)} AS p, {_bit_sql('i', 1)} AS g, {_edge_sql(0)} AS pe, {_edge_sql(1)} AS ge FROM orders, (SELECT unnest(range(36)) AS i)),
m AS (SELECT mission_id, mask_id, mask_id % 9 <> 4 AS here, count(*) FILTER (WHERE p AND g) AS inter, count(*) FILTER (WHERE p OR g) AS either, count(*) FILTER (WHERE pe AND ge) AS hit, count(*) FILTER (WHERE pe) AS n_p, count(*) FILTER (WHERE ge) AS n_g FROM b GROUP BY ALL)
SELECT mission_id, round(avg(CASE WHEN NOT here OR either = 0 THEN 0 ELSE inter / either END), 6) AS j, round(avg(CASE WHEN NOT here OR hit = 0 THEN 0 ELSE 2 * (hit / n_p) * (hit / n_g) / (hit / n_p + hit / n_g) END), 6) AS f FROM m GROUP BY mission_id""")
def m6(t):
    bits = lambda seed: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.when((F.col("o_orderkey") * 7 + i * i + seed) % 5 < 3, "1").otherwise("0")), "")
    masks = lambda seed: t.raw("orders").select((F.col("o_custkey").cast("bigint")).alias("mission_id"), F.col("o_orderkey").alias("mask_id"), F.lit(6).alias("width"), F.lit(6).alias("height"), bits(seed).alias("bits"))
    return M.mask_quality(masks(0).filter("mask_id % 9 <> 4"), masks(1))


@query("m7_depth_error", ["geometry", "truth"], """
, s AS (SELECT g.mission_id, g.depth_m AS p, t.depth_m AS g, g.metric_scale AS scale FROM geometry g JOIN truth t ON g.mission_id = t.mission_id AND g.subject_id = replace(t.gt_id, 'g', 's') AND g.t_sec = t.t_sec),
m AS (SELECT mission_id, bool_or(scale = 'relative') AS relative, list_sort(list(p))[CAST(count(*) // 2 + 1 AS INTEGER)] AS mp, list_sort(list(g))[CAST(count(*) // 2 + 1 AS INTEGER)] AS mg FROM s GROUP BY 1)
SELECT mission_id, round(avg(abs(CASE WHEN relative AND mp <> 0 THEN p / mp ELSE p END - CASE WHEN relative AND mg <> 0 THEN g / mg ELSE g END)), 6) AS depth_mae FROM s JOIN m USING (mission_id) GROUP BY 1""")
def m7(t):
    truth = t("truth").select("mission_id", F.regexp_replace("gt_id", "g", "s").alias("subject_id"), "t_sec", "depth_m")
    return M.depth_error(t("geometry"), truth)


@query("m8_box_quality", ["geometry", "truth"], """
, s AS (SELECT t.mission_id, g.mission_id IS NOT NULL AS here, g.ex, g.ey, g.ez,
 greatest(0, least(g.cx + g.ex / 2, t.cx + g2.ex / 2) - greatest(g.cx - g.ex / 2, t.cx - g2.ex / 2)) * greatest(0, least(g.cy + g.ey / 2, t.cy + g2.ey / 2) - greatest(g.cy - g.ey / 2, t.cy - g2.ey / 2)) * greatest(0, least(g.cz + g.ez / 2, t.cz + g2.ez / 2) - greatest(g.cz - g.ez / 2, t.cz - g2.ez / 2)) AS i,
 g.ex * g.ey * g.ez AS va, g2.ex * g2.ey * g2.ez AS vb, sqrt(pow(g.cx - t.cx, 2) + pow(g.cy - t.cy, 2) + pow(g.cz - t.cz, 2)) AS off
 FROM truth t LEFT JOIN (SELECT * FROM geometry WHERE depth_m < 5) g ON g.mission_id = t.mission_id AND g.subject_id = replace(t.gt_id, 'g', 's') AND g.t_sec = t.t_sec, (SELECT 1e0 AS ex, 1e0 AS ey, 1e0 AS ez) g2)
SELECT mission_id, round(avg(CASE WHEN here THEN i / (va + vb - i) ELSE 0 END), 6) AS iou_3d, round(avg(CASE WHEN here THEN off END), 6) AS centre_error_m FROM s GROUP BY mission_id""")
def m8(t):
    one = F.lit(1.0)
    truth = t("truth").select("mission_id", F.regexp_replace("gt_id", "g", "s").alias("subject_id"), "t_sec", "cx", "cy", "cz", one.alias("ex"), one.alias("ey"), one.alias("ez"))
    return M.box_quality(t("geometry").filter("depth_m < 5"), truth)


def _intervals(t, table, keep, shift=0.0):
    rows = t(table).filter(keep)
    return rows.withColumn("start_sec", F.col("start_sec") + shift)


@query("m9_relation_quality", [], None)
def m9(t):
    keys = ["mission_id", "subject_id", "predicate", "object_id"]
    pred = _intervals(t, "edges", "status = 'accepted'").withColumn("pred_id", F.col("edge_id"))
    truth = _intervals(t, "edges", "edge_id % 5 <> 2", 0.25).withColumn("truth_id", F.col("edge_id"))
    return M.interval_quality(pred, truth, keys)


@query("m10_event_quality", [], None)
def m10(t):
    keys = ["mission_id", "type", "participant"]
    pred = _intervals(t, "timeline", "status = 'accepted'").withColumn("pred_id", F.col("event_id"))
    truth = _intervals(t, "timeline", "event_id % 5 <> 2", 0.25).withColumn("truth_id", F.col("event_id"))
    return M.interval_quality(pred, truth, keys)


@query("m11_verifier_rates", ["proposals"], """
, w AS (SELECT mission_id, proposal_id, proposal_id % 3 <> 0 AS should_accept FROM proposals)
SELECT w.mission_id, round(avg(CASE WHEN NOT should_accept THEN CASE WHEN p.status = 'accepted' THEN 1.0 ELSE 0.0 END END), 6) AS false_accept, round(avg(CASE WHEN should_accept THEN CASE WHEN p.status = 'rejected' THEN 1.0 ELSE 0.0 END END), 6) AS false_reject
FROM w LEFT JOIN proposals p USING (proposal_id) GROUP BY w.mission_id""")
def m11(t):
    p = t("proposals")
    return M.verifier_rates(p, p.select("mission_id", "proposal_id", (F.col("proposal_id") % 3 != 0).alias("should_accept")))


@query("m12_qa_accuracy", ["timeline"], " SELECT mission_id, round(avg(CASE WHEN event_id % 4 = event_id % 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM timeline WHERE status = 'accepted' GROUP BY mission_id")
def m12(t):
    e = t("timeline")
    answers = e.select("mission_id", F.col("event_id").alias("qa_id"), "status", (F.col("event_id") % 4).cast("string").alias("answer"))
    return M.qa_accuracy(answers, e.select(F.col("event_id").alias("qa_id"), (F.col("event_id") % 3).cast("string").alias("answer")))


@query("m13_roll_up", ["tracks", "truth", "geometry"], """
, c AS (SELECT mission_id, t_sec, label, count(*) AS n FROM truth GROUP BY ALL), a AS (SELECT mission_id, t_sec, label, count(*) AS n FROM tracks WHERE state IN ('tentative', 'confirmed') GROUP BY ALL),
m AS (SELECT mission_id, round(avg(abs(coalesce(a.n, 0) - c.n)), 6) AS count_mae FROM c LEFT JOIN a USING (mission_id, t_sec, label) GROUP BY mission_id),
g AS (SELECT mission_id, avg(depth_m) AS depth_error, count(*) AS identity_switches, max(t_sec) AS queue_depth FROM geometry WHERE ex < 3 GROUP BY 1),
t AS (SELECT DISTINCT mission_id, state FROM tracks)
SELECT count(*) AS missions, round(avg(count_mae), 4) AS count_mae, round(avg(depth_error), 4) AS depth_error, CAST(sum(identity_switches) AS BIGINT) AS identity_switches, max(queue_depth) AS max_queue_depth,
  (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT unnest(['occluded', 'lost', 'camera_cut', 'empty']) AS w) WHERE w NOT IN (SELECT state FROM t WHERE mission_id % 4 <> 0)) AS missing
FROM m LEFT JOIN g USING (mission_id) WHERE mission_id % 4 <> 0""")
def m13(t):
    per = M.count_mae(t("tracks"), t("truth").groupBy("mission_id", "t_sec", "label").agg(F.count("*").alias("count"))).withColumnRenamed("mae", "count_mae")
    more = t("geometry").filter("ex < 3").groupBy("mission_id").agg(F.avg("depth_m").alias("depth_error"), F.count("*").alias("identity_switches"), F.max("t_sec").alias("queue_depth"))
    states = t("tracks").groupBy("mission_id").agg(F.collect_set("state").alias("conditions"))
    metrics = per.join(more, "mission_id", "left").join(states, "mission_id", "left").withColumn("valid", F.col("mission_id") % 4 != 0)
    row = M.roll_up(metrics, ["count_mae", "depth_error"], ["identity_switches"], ["queue_depth"], ["occluded", "lost", "camera_cut", "empty"])
    return row.select("missions", F.round("count_mae", 4).alias("count_mae"), F.round("depth_error", 4).alias("depth_error"), "identity_switches", "max_queue_depth", F.array_join("missing", ",").alias("missing"))
