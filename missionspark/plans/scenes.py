"""Queries of point clouds, checked events and model outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import cloud as C
from ..operators import graph as V
from ..operators import logs as G
from ..operators import metrics as M
from .registry import query


@query("a11_centroid_distance", [], None)
def a11(t):
    return C.centroid_distance(t("points").select("id", F.col("embedding").alias("vector")))


def _cloud(t):
    """Clouds of at least a dozen points: samples of eight missions as one track's."""
    g = t("geometry")
    return g.select(F.floor(F.col("mission_id") / 8).alias("track_id"), (F.col("t_sec") % 2).alias("t_sec"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))


ROBUST = """
, p AS (SELECT CAST(floor(mission_id / 8) AS BIGINT) AS track_id, t_sec % 2 AS t_sec, cx AS x, cy AS y, cz AS z FROM geometry),
m AS (SELECT *, median(x) OVER k AS mx, median(y) OVER k AS my, median(z) OVER k AS mz FROM p WINDOW k AS (PARTITION BY track_id, t_sec)),
d AS (SELECT *, median(abs(x - mx)) OVER k AS dx, median(abs(y - my)) OVER k AS dy, median(abs(z - mz)) OVER k AS dz FROM m WINDOW k AS (PARTITION BY track_id, t_sec)),
i AS (SELECT *, abs(x - mx) <= 8 * (dx + 1e-9) AND abs(y - my) <= 8 * (dy + 1e-9) AND abs(z - mz) <= 8 * (dz + 1e-9) AS inside FROM d),
s AS (SELECT *, count(*) OVER k AS n, count(*) FILTER (WHERE inside) OVER k AS n_inside FROM i WINDOW k AS (PARTITION BY track_id, t_sec)),
r AS (SELECT * FROM s WHERE n >= 12 AND (inside OR n_inside < 12))"""


@query("a13_box_fit", ["geometry"], ROBUST + """
, u AS (SELECT track_id, t_sec, z, s.step, x * cos(radians(s.step / 2e0)) + y * sin(radians(s.step / 2e0)) AS u, y * cos(radians(s.step / 2e0)) - x * sin(radians(s.step / 2e0)) AS v FROM r, (SELECT unnest(range(360)) AS step) s),
b AS (SELECT track_id, t_sec, step, round((max(u) - min(u)) * (max(v) - min(v)), 9) AS area, greatest(max(u) - min(u), 0.001) AS length, greatest(max(v) - min(v), 0.001) AS width, greatest(max(z) - min(z), 0.001) AS height, count(*) AS n FROM u GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY track_id, t_sec ORDER BY area, step) AS place FROM b),
q AS (SELECT *, median(x) OVER k AS qx, median(y) OVER k AS qy, median(z) OVER k AS qz FROM r WINDOW k AS (PARTITION BY track_id, t_sec)),
f AS (SELECT *, sqrt(pow(x - qx, 2) + pow(y - qy, 2) + pow(z - qz, 2)) AS far FROM q),
h AS (SELECT *, median(far) OVER (PARTITION BY track_id, t_sec) AS usual FROM f),
e AS (SELECT track_id, t_sec, var_pop(x) / count(*) AS var_x, var_pop(y) / count(*) AS var_y, var_pop(z) / count(*) AS var_z, median(abs(far - usual)) AS residual FROM h GROUP BY ALL)
SELECT track_id, t_sec, step / 2e0 AS yaw, round(length, 6) AS length, round(width, 6) AS width, round(height, 6) AS height, n, round(sqrt(var_x), 6) AS sd_x, round(sqrt(var_y), 6) AS sd_y, round(sqrt(var_z), 6) AS sd_z, round(residual, 6) AS residual FROM o JOIN e USING (track_id, t_sec) WHERE place = 1""")
def a13(t):
    return C.box_fit(_cloud(t)).select("track_id", "t_sec", "yaw", *[F.round(c, 6).alias(c) for c in ("length", "width", "height")], "n", *[F.round(F.sqrt(f"var_{c}"), 6).alias(f"sd_{c}") for c in "xyz"], F.round("residual", 6).alias("residual"))


#: Two cameras: a calibrated one that is turned by a quarter and a distorting one without calibration.
CAMERAS = """
, c AS (SELECT * FROM (VALUES (0, 500e0, 500e0, 320e0, 240e0, 0.05e0, 0.01e0, 0e0, 0e0, 1e0, true), (1, 400e0, 410e0, 300e0, 200e0, 0.02e0, 0e0, 1e0, 2e0, 0e0, false)) v(camera_id, fu, fv, cu, cv, k1, k2, px, py, pz, calibrated)),
q AS (SELECT CAST(floor(mission_id / 8) AS BIGINT) AS track_id, t_sec, CAST(floor(mission_id / 8) AS BIGINT) % 2 AS camera_id, cx * 60 AS u, cy * 90 AS v, depth_m AS depth FROM geometry WHERE ex > 0.6),
j AS (SELECT q.*, c.* EXCLUDE (camera_id), median(depth) OVER k AS unit, count(*) OVER k AS n FROM q JOIN c USING (camera_id) WINDOW k AS (PARTITION BY track_id, t_sec)),
u0 AS (SELECT *, CASE WHEN calibrated THEN depth ELSE depth / unit END AS d, (u - cu) / fu AS xd, (v - cv) / fv AS yd, (u - cu) / fu AS xn, (v - cv) / fv AS yn FROM j WHERE calibrated OR n >= 12)""" + "".join(
    f",\nu{k} AS (SELECT * REPLACE (xd / (1 + k1 * (xn * xn + yn * yn) + k2 * pow(xn * xn + yn * yn, 2)) AS xn, yd / (1 + k1 * (xn * xn + yn * yn) + k2 * pow(xn * xn + yn * yn, 2)) AS yn) FROM u{k - 1})" for k in range(1, 9)
) + """,
w AS (SELECT track_id, t_sec, CASE WHEN camera_id = 0 THEN yn * d ELSE xn * d END + px AS x, CASE WHEN camera_id = 0 THEN -xn * d ELSE yn * d END + py AS y, d + pz AS z,
  sqrt(pow(xn * (1 + k1 * (xn * xn + yn * yn) + k2 * pow(xn * xn + yn * yn, 2)) * fu + cu - u, 2) + pow(yn * (1 + k1 * (xn * xn + yn * yn) + k2 * pow(xn * xn + yn * yn, 2)) * fv + cv - v, 2)) AS px_off FROM u8)"""


def _world(t):
    track = F.floor(F.col("mission_id") / 8)
    pixels = t("geometry").select(track.alias("track_id"), "t_sec", (track % 2).alias("camera_id"), (F.col("cx") * 60).alias("u"), (F.col("cy") * 90).alias("v"), F.col("depth_m").alias("depth"), (F.col("ex") > 0.6).alias("mask"))
    quarter, none = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    two = [(0, 500.0, 500.0, 320.0, 240.0, 0.05, 0.01, 0.0, 0.0, 1.0, True, quarter), (1, 400.0, 410.0, 300.0, 200.0, 0.02, 0.0, 1.0, 2.0, 0.0, False, none)]
    cameras = t.spark.createDataFrame(two, "camera_id long, fu double, fv double, cu double, cv double, k1 double, k2 double, px double, py double, pz double, calibrated boolean, rotation array<double>")
    return C.backproject(pixels, cameras)


@query("a14_backproject", ["geometry"], CAMERAS + " SELECT track_id, t_sec, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) AS z FROM w")
def a14(t):
    return _world(t).select("track_id", "t_sec", *[(F.round(c, 6) + 0.0).alias(c) for c in "xy"], F.round("z", 6).alias("z"))


@query("a14_reprojection", ["geometry"], CAMERAS + " SELECT track_id, t_sec, round(avg(px_off), 6) AS error_px, count(*) AS n FROM w GROUP BY ALL")
def a14_error(t):
    return C.reprojection_error(_world(t)).withColumn("error_px", F.round("error_px", 6))


@query("a16_fuse_motion", ["geometry"], """
, p AS (SELECT mission_id, subject_id, t_sec, cx AS x, ex > 1 AS dynamic FROM geometry),
n AS (SELECT mission_id, subject_id, max(t_sec) AS last FROM p WHERE dynamic GROUP BY ALL),
r AS (SELECT p.* FROM p JOIN n USING (mission_id, subject_id) WHERE dynamic AND t_sec >= last - 1),
k AS (SELECT mission_id, subject_id, arg_max(x, t_sec) AS x FROM r GROUP BY ALL)
SELECT r.mission_id, r.subject_id, r.t_sec, round(k.x, 6) AS x FROM r JOIN k USING (mission_id, subject_id) UNION ALL SELECT mission_id, subject_id, t_sec, round(x, 6) FROM p WHERE NOT dynamic""")
def a16(t):
    points = t("geometry").select("mission_id", "subject_id", "t_sec", (F.col("ex") > 1).alias("dynamic"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return A.fuse_motion(points).select("mission_id", "subject_id", "t_sec", F.round("x", 6).alias("x"))


@query("m14_baseline_comparison", [], None)
def m14(t):
    keys = ["mission_id", "subject_id", "predicate", "object_id"]
    e = t("edges")
    truth = e.filter("edge_id % 5 <> 2").withColumn("truth_id", F.col("edge_id"))
    ours = M.interval_quality(e.filter("status = 'accepted'").withColumn("pred_id", F.col("edge_id")), truth, keys)
    base = M.interval_quality(e.filter("edge_id % 4 = 0").withColumn("predicate", F.lit("left_of")).withColumn("pred_id", F.col("edge_id")), truth, keys)
    base = base.select(F.col("mission_id").alias("b"), F.col("precision").alias("baseline_precision"))
    return ours.join(base, F.col("mission_id") == F.col("b"), "left").select("mission_id", "precision", F.coalesce("baseline_precision", F.lit(0.0)).alias("baseline_precision"))


#: Cited edges and events by the id of a claim.
CITED = """
, g AS (SELECT *, cx / 15 AS residual, cy / 2 AS covariance FROM geometry),
d AS (SELECT proposal_id AS delta_id, mission_id, ['left_of', 'right_of', 'above', 'below', 'contains', 'supports', 'distance_band', 'visible', 'relative_motion', 'next_to'][proposal_id % 10 + 1] AS predicate, concat('s', proposal_id % 4 + 1) AS subject_id,
  concat('s', (proposal_id + 2) % 6 + 1) AS object_id, (proposal_id % 7) * 0.5e0 AS start_sec, (proposal_id % 7) * 0.5e0 + 0.75e0 AS end_sec FROM proposals),
e AS (SELECT proposal_id AS event_id, mission_id, proposal_id % 11 <> 0 AS accepted, proposal_id % 5 = 0 AS counts, proposal_id % 5 > 1 AS cites, proposal_id % 7 <> 0 AS proved, [concat('s', proposal_id % 4 + 1), concat('s', proposal_id % 9)] AS participants FROM proposals),
c AS (SELECT event_id, 0 AS place, d.* FROM e JOIN d ON d.delta_id = event_id WHERE cites UNION ALL SELECT event_id, 1, d.* FROM e JOIN d ON d.delta_id = event_id - 1 AND d.mission_id = e.mission_id WHERE cites),
sa AS (SELECT c.event_id, c.place, g.* FROM c JOIN g ON g.mission_id = c.mission_id AND g.subject_id = c.subject_id AND g.t_sec >= c.start_sec AND g.t_sec < c.end_sec),
sb AS (SELECT c.event_id, c.place, g.* FROM c JOIN g ON g.mission_id = c.mission_id AND g.subject_id = c.object_id AND g.t_sec >= c.start_sec AND g.t_sec < c.end_sec),
p AS (SELECT a.event_id, a.place, a AS a, b AS b, row_number() OVER (PARTITION BY a.event_id, a.place ORDER BY abs(a.t_sec - b.t_sec), a.t_sec, b.t_sec) AS nth FROM sa a JOIN sb b USING (event_id, place)),
m AS (SELECT event_id, place, count(*) AS n, sqrt(pow(arg_max(cx, t_sec) - arg_min(cx, t_sec), 2) + pow(arg_max(cy, t_sec) - arg_min(cy, t_sec), 2) + pow(arg_max(cz, t_sec) - arg_min(cz, t_sec), 2)) AS moved FROM sa GROUP BY ALL),
h AS (SELECT c.*, a, b, CASE WHEN m.n >= 2 THEN moved END AS moved, predicate IN ('supports', 'distance_band') AS metric, a.cx - a.ex / 2 <= b.cx + b.ex / 2 AND b.cx - b.ex / 2 <= a.cx + a.ex / 2 AND a.cy - a.ey / 2 <= b.cy + b.ey / 2 AND b.cy - b.ey / 2 <= a.cy + a.ey / 2 AS over_xy
  FROM c LEFT JOIN p ON p.event_id = c.event_id AND p.place = c.place AND nth = 1 LEFT JOIN m ON m.event_id = c.event_id AND m.place = c.place),
o AS (SELECT *, metric AND (a.metric_scale <> 'metric' OR a.calibration_id IS NULL OR b.metric_scale <> 'metric' OR b.calibration_id IS NULL OR a.covariance > 1 OR b.covariance > 1) OR a.residual > 0.5 OR b.residual > 0.5 AS gated,
  CASE predicate WHEN 'left_of' THEN a.cx + 0.05e0 < b.cx WHEN 'right_of' THEN a.cx > b.cx + 0.05e0 WHEN 'above' THEN a.cz > b.cz + 0.05e0 WHEN 'below' THEN a.cz + 0.05e0 < b.cz
    WHEN 'contains' THEN a.cx - a.ex / 2 <= b.cx - b.ex / 2 AND b.cx + b.ex / 2 <= a.cx + a.ex / 2 AND a.cy - a.ey / 2 <= b.cy - b.ey / 2 AND b.cy + b.ey / 2 <= a.cy + a.ey / 2 AND a.cz - a.ez / 2 <= b.cz - b.ez / 2 AND b.cz + b.ez / 2 <= a.cz + a.ez / 2
    WHEN 'supports' THEN over_xy AND abs(b.cz - b.ez / 2 - (a.cz + a.ez / 2)) <= 0.05 WHEN 'distance_band' THEN sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)) <= 8 WHEN 'visible' THEN true
    WHEN 'relative_motion' THEN coalesce(moved > 0.05, false) ELSE false END AS holds FROM h),
w AS (SELECT event_id, place, CASE WHEN metric AND mission_id % 4 = 0 THEN ['uncertain', predicate, 'metric_scale_missing'] WHEN a IS NULL THEN ['uncertain', predicate, 'missing_geometry'] WHEN gated THEN ['uncertain', predicate, 'uncertainty_gate']
  WHEN NOT holds THEN ['rejected', concat(predicate, ',geometry'), 'geometry_contradiction'] END AS failed FROM o),
x AS (SELECT event_id, arg_min(failed, place) FILTER (WHERE failed IS NOT NULL) AS failed FROM w GROUP BY 1),
v AS (SELECT e.event_id, CASE WHEN NOT accepted THEN ['uncertain', 'old', 'older'] WHEN NOT proved THEN ['rejected', CASE WHEN counts THEN 'track_count' ELSE 'geometry' END, 'missing_evidence'] WHEN x.event_id IS NOT NULL THEN coalesce(failed, ['accepted', 'geometry', ''])
  WHEN counts THEN CASE WHEN (SELECT count(DISTINCT track_id) FROM tracks t WHERE t.mission_id = e.mission_id AND list_contains(participants, t.track_id)) < len(list_distinct(participants)) THEN ['rejected', 'track_count', 'dangling_id'] ELSE ['accepted', 'track_count', ''] END
  ELSE ['uncertain', 'geometry', 'unrecomputed'] END AS v FROM e LEFT JOIN x USING (event_id))"""


@query("v10_recheck", ["proposals", "geometry", "tracks"], CITED + " SELECT event_id, v[1] AS status, v[2] AS rules, v[3] AS reasons FROM v")
def v10(t):
    i, words = F.col("proposal_id"), lambda *names: F.array(*map(F.lit, names))
    start = (i % 7) * 0.5
    names = words("left_of", "right_of", "above", "below", "contains", "supports", "distance_band", "visible", "relative_motion", "next_to")
    s = lambda n: F.concat(F.lit("s"), n)
    edges = t("proposals").select("mission_id", i.alias("delta_id"), F.get(names, (i % 10).cast("int")).alias("predicate"), s(i % 4 + 1).alias("subject_id"), s((i + 2) % 6 + 1).alias("object_id"), start.alias("start_sec"), (start + 0.75).alias("end_sec"), F.lit(0.0).alias("band_low"), F.lit(8.0).alias("band_high"))
    old, none = i % 11 == 0, F.array().cast("array<bigint>")
    events = t("proposals").select(
        i.alias("event_id"), "mission_id", F.when(old, "uncertain").otherwise("accepted").alias("status"), F.when(old, words("old")).when(i % 5 == 0, words("track_count")).otherwise(words("geometry")).alias("rules"),
        F.when(old, words("older")).otherwise(F.array().cast("array<string>")).alias("reasons"), F.array(s(i % 4 + 1), s(i % 9)).alias("participants"), F.when(i % 5 > 1, F.array(i, i - 1)).otherwise(none).alias("refs"),
    )
    evidence = t("proposals").select("mission_id", i.alias("event_id"), F.concat(F.lit("geometry/"), i).alias("geometry_ref"), F.lit(None).cast("string").alias("mask_ref"))
    files = evidence.filter("event_id % 7 <> 0").select("mission_id", F.col("geometry_ref").alias("path"))
    samples = t("geometry").withColumn("residual_m", F.col("cx") / 15).withColumn("covariance", F.col("cy") / 2)
    out = V.recheck(V.evidenced(events, evidence, files), edges, samples, t("tracks"), samples.filter("mission_id % 4 <> 0").select("mission_id"))
    return out.select("event_id", "status", F.array_join("rules", ",").alias("rules"), F.array_join("reasons", ",").alias("reasons"))


@query("v11_claim_count_events", ["proposals", "timeline", "tracks", "geometry"], """
, c AS (SELECT proposal_id AS claim_id, mission_id, CAST((proposal_id // 13) % 3 AS INTEGER) AS said, CASE proposal_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'box' END AS label, CASE WHEN proposal_id % 11 <> 0 THEN (proposal_id % 7) * 0.5e0 END AS at_sec FROM proposals WHERE status = 'accepted'),
k AS (SELECT claim_id, list_sort(list(track_id)) AS ids FROM (SELECT c.claim_id, t.track_id, arg_max(t.state, t.t_sec) AS state FROM c JOIN tracks t ON t.mission_id = c.mission_id AND t.label = c.label AND t.t_sec <= coalesce(at_sec, 0) + 1e-6 GROUP BY ALL) WHERE state IN ('tentative', 'confirmed', 'occluded') GROUP BY 1),
s AS (SELECT mission_id, subject_id, min(t_sec) AS t_sec, arg_min(sample_id, t_sec) AS sample_id FROM geometry WHERE subject_id <> 's4' AND t_sec >= 0.5e0 GROUP BY ALL),
r AS (SELECT concat('evt-count-', label, '-', lpad(CAST(CAST(round_even(coalesce(at_sec, s.t_sec) * 1000, 0) AS BIGINT) AS VARCHAR), 7, '0')) AS event_id, c.mission_id, said AS n, array_to_string(ids, ',') AS ids, s.sample_id AS evidence_id, coalesce(at_sec, s.t_sec) AS start_sec, ids AS those
  FROM c JOIN k USING (claim_id) JOIN s ON s.mission_id = c.mission_id AND s.subject_id = ids[1] WHERE len(ids) = said AND said > 0)
SELECT event_id, mission_id, n, ids, evidence_id, start_sec FROM r WHERE NOT EXISTS (SELECT 1 FROM timeline e WHERE e.type = 'count_changed' AND e.mission_id = r.mission_id AND [e.participant] = those) AND NOT (mission_id % 5 = 0 AND event_id = 'evt-count-car-0000500')""")
def v11(t):
    i = F.col("proposal_id")
    number = F.get(F.array(*map(F.lit, ("zero", "One", "2"))), (F.floor(i / 13) % 3).cast("int"))
    label = F.get(F.array(*map(F.lit, ("Persons", "cars", "box"))), (i % 3).cast("int"))
    claims = t("proposals").filter("status = 'accepted'").select(i.alias("claim_id"), "mission_id", F.concat_ws(" ", number, label, F.lit("wait")).alias("text"), F.when(i % 11 != 0, (i % 7) * 0.5).alias("start_sec"))
    events = t("timeline").select("mission_id", F.col("event_id").cast("string").alias("event_id"), "type", F.array("participant").alias("participants"))
    events = events.unionByName(t("tracks").filter("mission_id % 5 = 0").select("mission_id", F.lit("evt-count-car-0000500").alias("event_id"), F.lit("approached").alias("type"), F.array("track_id").alias("participants")))
    samples = t("geometry").filter("subject_id <> 's4' and t_sec >= 0.5").withColumn("subject_id", F.when(F.col("subject_id") == "s1", "node-1").otherwise(F.col("subject_id")))
    nodes = samples.filter("subject_id = 'node-1'").select("mission_id", F.col("subject_id").alias("node_id"), F.lit("s1").alias("track_id")).distinct()
    return V.claim_count_events(claims, t("tracks"), nodes, samples, events).select("event_id", "mission_id", "n", F.array_join("ids", ",").alias("ids"), "evidence_id", "start_sec")


@query("v13_screen_claims", ["proposals", "geometry"], """
, c AS (SELECT proposal_id AS claim_id, mission_id, ['left_of', 'right_of', 'above', 'below', 'occludes', 'distance_band', 'visible', 'next_to'][proposal_id % 8 + 1] AS predicate, concat('s', proposal_id % 4 + 1) AS l, concat('s', (proposal_id + 2) % 6 + 1) AS r, CASE WHEN proposal_id % 5 <> 0 THEN (proposal_id % 9) * 0.45e0 END AS at_sec FROM proposals),
a AS (SELECT claim_id, predicate, g.* FROM c JOIN geometry g ON g.mission_id = c.mission_id AND g.subject_id = l QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN at_sec IS NULL THEN -t_sec ELSE abs(t_sec - at_sec) END, t_sec) = 1),
b AS (SELECT claim_id, g.* FROM c JOIN geometry g ON g.mission_id = c.mission_id AND g.subject_id = r QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN at_sec IS NULL THEN -t_sec ELSE abs(t_sec - at_sec) END, t_sec) = 1)
SELECT claim_id FROM a JOIN b USING (claim_id) WHERE NOT CASE predicate WHEN 'left_of' THEN a.cx + 0.05e0 < b.cx WHEN 'right_of' THEN a.cx > b.cx + 0.05e0 WHEN 'above' THEN a.cz > b.cz + 0.05e0 WHEN 'below' THEN a.cz + 0.05e0 < b.cz WHEN 'distance_band' THEN false
  WHEN 'occludes' THEN a.depth_m + 0.05e0 < b.depth_m AND a.cx - a.ex / 2 <= b.cx + b.ex / 2 AND b.cx - b.ex / 2 <= a.cx + a.ex / 2 AND a.cy - a.ey / 2 <= b.cy + b.ey / 2 AND b.cy - b.ey / 2 <= a.cy + a.ey / 2 ELSE true END""")
def v13(t):
    i = F.col("proposal_id")
    names = F.array(*map(F.lit, ("left_of", "right_of", "above", "below", "occludes", "distance_band", "visible", "next_to")))
    claims = t("proposals").select(i.alias("claim_id"), "mission_id", F.get(names, (i % 8).cast("int")).alias("predicate"), F.concat(F.lit("s"), i % 4 + 1).alias("subject_id"), F.concat(F.lit("s"), (i + 2) % 6 + 1).alias("object_id"), F.when(i % 5 != 0, (i % 9) * 0.45).alias("start_sec"))
    return V.screen_claims(claims, t("geometry").select("mission_id", "subject_id", "t_sec", "cx", "cy", "cz", "ex", "ey", "ez", "depth_m"))


@query("p9_run_rows", ["missions", "timeline", "edges", "proposals"], """
, m AS (SELECT mission_id, concat('{"coordinate_frame":{"calibration_id":', CASE WHEN mission_id % 3 = 0 THEN 'null' ELSE '"cal"' END, ',"metric_scale":"metric","name":"world"},"mission_id":"m-', mission_id, '","profile":"', status, '","schema_version":"1","supersedes_sha256":', CASE WHEN mission_id % 2 = 0 THEN concat('"sha256:', robot_id, '"') ELSE 'null' END, '}') AS manifest FROM missions WHERE mission_id % 5 <> 0),
r AS (SELECT mission_id, sha256(manifest) AS run_id, status AS profile, CASE WHEN mission_id % 3 <> 0 THEN 'cal' END AS cal, CASE WHEN mission_id % 2 = 0 THEN robot_id END AS supersedes FROM m JOIN missions USING (mission_id))
SELECT 'run' AS kind, run_id, CAST(mission_id AS VARCHAR) AS id, profile AS status, cal AS about, supersedes, CAST(NULL AS BIGINT) AS n FROM r
UNION ALL SELECT 'events', run_id, CAST(event_id AS VARCHAR), status, type, NULL, n_evidence FROM timeline JOIN r USING (mission_id)
UNION ALL SELECT 'edges', run_id, CAST(edge_id AS VARCHAR), status, predicate, NULL, NULL FROM edges JOIN r USING (mission_id)
UNION ALL SELECT 'qa', run_id, CAST(proposal_id AS VARCHAR), status, claim_kind, NULL, NULL FROM proposals JOIN r USING (mission_id)""")
def p9(t):
    i, text = F.col("mission_id"), F.lit
    manifest = F.concat(
        text('{"coordinate_frame":{"calibration_id":'), F.when(i % 3 == 0, "null").otherwise('"cal"'), text(',"metric_scale":"metric","name":"world"},"mission_id":"m-'), i.cast("string"), text('","profile":"'), "status",
        text('","schema_version":"1","supersedes_sha256":'), F.when(i % 2 == 0, F.concat(text('"sha256:'), "robot_id", text('"'))).otherwise("null"), text("}"),
    )
    manifests = t("missions").filter("mission_id % 5 <> 0").select("mission_id", manifest.alias("manifest"), F.lit("artifacts").alias("artifact_dir"))
    events = t("timeline").withColumn("evidence", F.array_repeat(F.lit("x"), F.col("n_evidence").cast("int")))
    found = G.run_tables(manifests, events, t("edges"), t("proposals"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, key, status, about, supersedes, n: found[kind].select(F.lit(kind).alias("kind"), "run_id", F.col(key).cast("string").alias("id"), F.col(status).alias("status"), F.col(about).alias("about"), supersedes.alias("supersedes"), n.cast("long").alias("n"))
    parts = [row("run", "mission_id", "profile", "calibration_id", F.col("supersedes_run_id"), none("long")), row("events", "event_id", "status", "type", none("string"), F.col("evidence_count"))]
    parts += [row("edges", "edge_id", "status", "predicate", none("string"), none("long")), row("qa", "proposal_id", "status", "claim_kind", none("string"), none("long"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("u2_degradations", ["missions", "timeline"], """
SELECT mission_id, 'depth' AS stage, 'provider_unavailable' AS code FROM missions UNION ALL SELECT mission_id, 'events', 'no_result' FROM missions WHERE mission_id NOT IN (SELECT mission_id FROM timeline)""")
def u2(t):
    return V.degradations(t("missions"), {"depth": None, "events": t("timeline")})
