"""Queries of the sources and sinks on files: what they read is written from the given tables first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import graph as V
from ..operators import logs as G
from ..sources.storage import materialise, new_path
from ..streaming import packets as T
from .registry import query


def _lines(t, rows, name: str) -> str:
    """Folder with the rows' ``value`` as lines."""
    path = new_path(t.spark, name)
    rows.select("value").write.text(path)
    return path


def _object(*pairs):
    """JSON text of (name, column) pairs; text columns are quoted."""
    parts = [F.concat(F.lit(f'"{name}":'), c) for name, c in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


@query("s1_scan_log", [], """
SELECT CASE event_id % 10 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'unknown_field' WHEN 2 THEN 'wrong_version' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'wrong_version' ELSE 'ok' END AS code, count(*) AS n, CAST(sum(CASE WHEN event_id % 10 > 4 THEN event_id END) AS BIGINT) AS ids FROM events GROUP BY 1""")
def s1(t):
    e = F.col("event_id")
    row = lambda *more: _object(("event_id", e.cast("string")), *more)
    version = ("schema_version", F.lit('"1"'))
    k = e % 10
    value = F.when(k == 0, F.lit('{"event_id": 1')).when(k == 1, row(("odd", F.lit("1")), version)).when(k == 2, row(("schema_version", F.lit('"2"')))).when(k == 3, F.lit("[1]")).when(k == 4, row()).otherwise(row(version))
    path = _lines(t, t.raw("events").select(value.alias("value")), "log")
    rows, issues = G.read_log(t.spark, path, "event_id long", ["event_id"], "1")
    told = rows.select(F.lit("ok").alias("code"), "event_id").unionByName(issues.select("code", F.lit(None).cast("long").alias("event_id")))
    return told.groupBy("code").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _tree(t) -> str:
    """A folder tree with one document for each supplier; one of nine isn't the schema's."""
    path = new_path(t.spark, "tree")
    s = t.raw("supplier")
    text = F.when(F.col("s_suppkey") % 9 == 0, F.lit("no document")).otherwise(_object(("id", F.col("s_suppkey").cast("string")), ("nation", F.col("s_nationkey").cast("string"))))
    rows = s.select(F.col("s_nationkey").alias("part"), F.col("s_suppkey").alias("file"), text.alias("value"))
    # Many small files: many tasks write them, and each moves its own in place, not the driver all of them one by one.
    tasks = max(1, min(2 * t.spark.sparkContext.defaultParallelism, rows.count() // 100))
    rows.repartition(tasks, "file").write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("part", "file").text(path)
    return path


@query("s2_scan_tree", [], " SELECT s_suppkey AS file, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey END AS id, CASE WHEN s_suppkey % 9 <> 0 THEN s_nationkey END AS nation FROM supplier")
def s2(t):
    docs = G.read_tree(t.spark, _tree(t), "id long, nation long")
    return docs.select(F.regexp_extract("file", r"/file=(\d+)/", 1).cast("long").alias("file"), "doc.id", "doc.nation")


@query("s3_audit_artifacts", [], """
SELECT CAST(s_nationkey AS BIGINT) AS mission_id, 'artifact' AS kind, CASE WHEN s_suppkey % 13 = 0 THEN 'escaping_path' WHEN s_suppkey % 11 = 0 THEN 'missing' ELSE 'mismatch' END AS code, count(*) AS n FROM supplier WHERE s_suppkey % 13 = 0 OR s_suppkey % 11 = 0 OR s_suppkey % 7 = 0 GROUP BY ALL
UNION ALL SELECT s_nationkey, 'manifest', 'required_once', 1 FROM supplier GROUP BY s_nationkey""")
def s3(t):
    stored = materialise(G.stored_files(t.spark, _tree(t)), "stored")  # manifests and their audit read it, the tree is read once
    here = stored.withColumn("id", F.regexp_extract("path", r"file=(\d+)/", 1).cast("long"))
    k = F.col("s_suppkey")
    named = t.raw("supplier").select(k, F.col("s_nationkey").cast("long").alias("mission_id")).join(here, k == F.col("id"))
    path = F.when(k % 13 == 0, F.concat(F.lit("../"), "path")).when(k % 11 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    manifests = named.select("mission_id", F.lit("artifact").alias("kind"), path.alias("path"), F.when(k % 7 == 0, "0").otherwise(F.col("digest")).alias("digest"), "size")
    return G.audit_artifacts(manifests, stored, ["manifest"]).groupBy("mission_id", "kind", "code").agg(F.count("*").alias("n"))


@query("s4_read_trace", [], " SELECT event_id, value AS reading FROM events WHERE event_id % 8 < 5")
def s4(t):
    k = F.col("event_id") % 8
    value = F.when(k == 5, F.lit("   ")).when(k == 6, F.lit("[1, 2]")).when(k == 7, F.lit("{broken")).otherwise(F.concat(F.lit("  "), _object(("event_id", F.col("event_id").cast("string")), ("reading", F.col("value").cast("string")))))
    trace = G.read_trace(t.spark, _lines(t, t.raw("events").select(value.alias("value")), "trace"))
    return trace.select(F.variant_get("v", "$.event_id", "long").alias("event_id"), F.variant_get("v", "$.reading", "double").alias("reading"))


@query("s5_bundle_inventory", [], """
WITH l AS (SELECT user_id % 25 AS file, event_id, event_id % 1000 AS t, event_id % 4 = 0 AS fix FROM events WHERE event_id % 6 <> 0)
SELECT file, count(*) AS "rows", CAST(min(t) AS DOUBLE) AS t_start_sec, CAST(max(t) AS DOUBLE) AS t_end_sec, CAST(min(t) FILTER (WHERE fix) AS DOUBLE) + 0.5 AS lat FROM l GROUP BY file""")
def s5(t):
    e = F.col("event_id")
    time = F.when(e % 3 == 0, F.concat(F.lit('"timestamp":"'), e % 1000, F.lit('"'))).otherwise(F.concat(F.lit('"t":'), e % 1000))
    fix = F.when(e % 4 == 0, F.concat(F.lit(',"lat":'), (e % 1000) + 0.5, F.lit(',"lon":1.0'))).otherwise(F.lit(',"lat":null,"lon":2.0'))
    value = F.when(e % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit("{"), time, fix, F.lit("}")))
    path = new_path(t.spark, "bundle")
    t.raw("events").select((F.col("user_id") % 25).alias("sidecar"), value.alias("value")).write.partitionBy("sidecar").text(path)
    lines = t.spark.read.text(path).select(F.col("sidecar").cast("long").alias("file"), "value")
    return G.bundle_inventory(lines).select("file", "rows", "t_start_sec", "t_end_sec", F.col("origin.lat").alias("lat"))


@query("s6_append_log", ["timeline"], " SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 1 ELSE 2 END AS batch FROM timeline UNION ALL SELECT -1, 0")
def s6(t):
    path = new_path(t.spark, "append")
    rows = t("timeline").select("event_id", F.when(F.col("event_id") % 2 == 1, 1).otherwise(2).alias("batch"))
    for batch in (1, 2):
        G.append_log(rows.filter(F.col("batch") == batch), path, "event_id")
    refused = 0
    for again in (rows.filter("event_id % 100 = 1"), rows.filter("event_id < 50").withColumn("event_id", -F.col("event_id") * 0 - 5)):
        try:
            G.append_log(again, path, "event_id")
        except ValueError:
            refused += 1
    told = t.spark.range(1).select((F.lit(-3) + refused).cast("long").alias("event_id"), F.lit(0).alias("batch"))
    return t.spark.read.parquet(path).unionByName(told)


@query("s7_history", ["proposals"], """
, v AS (SELECT proposal_id % 500 AS doc, proposal_id, row_number() OVER (PARTITION BY proposal_id % 500 ORDER BY proposal_id) AS version FROM proposals),
m AS (SELECT doc, max(version) AS version FROM v GROUP BY doc)
SELECT v.doc, CAST(v.version AS BIGINT) AS version, v.version = m.version AND v.doc % 3 <> 0 AS current FROM v JOIN m USING (doc) UNION ALL SELECT doc, CAST(version + 1 AS BIGINT), true FROM m WHERE doc % 3 = 0""")
def s7_history(t):
    from pyspark.sql import Window

    order = Window.partitionBy("doc").orderBy("proposal_id")
    versions = t("proposals").select((F.col("proposal_id") % 500).alias("doc"), "proposal_id").withColumn("version", F.row_number().over(order).cast("long"))
    versions = versions.select("doc", "version", F.sha2(F.col("proposal_id").cast("string"), 256).alias("digest"))
    last = versions.groupBy("doc").agg(F.max_by("digest", "version").alias("named"))
    new = last.select("doc", F.sha2(F.concat(F.lit("new"), "doc"), 256).alias("digest"), F.when(F.col("doc") % 3 == 0, F.col("named")).otherwise("stale").alias("supersedes_digest"))
    accepted, _ = G.supersede(versions, new, "doc")
    return G.history(versions, accepted, "doc").select("doc", "version", "current")


@query("s9_replace_partition", ["timeline"], " SELECT event_id, mission_id % 40 AS part, CASE WHEN mission_id % 40 % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM timeline WHERE mission_id % 40 % 3 <> 0 OR event_id % 2 = 0")
def s9(t):
    path = new_path(t.spark, "partitions")
    rows = t("timeline").select("event_id", F.lit("old").alias("state"), (F.col("mission_id") % 40).alias("part"))
    rows.write.partitionBy("part").parquet(path)
    G.replace_partition(rows.filter("part % 3 = 0 and event_id % 2 = 0").withColumn("state", F.lit("new")), path, "part")
    return t.spark.read.parquet(path).withColumn("part", F.col("part").cast("long")).select("event_id", "part", "state")


@query("s10_replace_run", ["timeline", "edges"], """
, r AS (SELECT DISTINCT mission_id % 12 AS run_id FROM timeline)
SELECT 'run' AS kind, run_id, CAST(NULL AS BIGINT) AS id, CASE WHEN run_id < 4 THEN 'second' ELSE 'first' END AS state FROM r
UNION ALL SELECT 'events', mission_id % 12, event_id, CASE WHEN mission_id % 12 < 4 THEN 'second' ELSE 'first' END FROM timeline WHERE mission_id % 12 >= 4 OR event_id % 2 = 0
UNION ALL SELECT 'edges', mission_id % 12, edge_id, 'first' FROM edges WHERE mission_id % 12 >= 4 AND mission_id % 12 IN (SELECT run_id FROM r)""")
def s10(t):
    folder = new_path(t.spark, "runs")
    run = (F.col("mission_id") % 12).alias("run_id")
    events, edges = t("timeline").select(run, F.col("event_id").alias("id")), t("edges").select(run, F.col("edge_id").alias("id"))
    runs = events.select("run_id").distinct().withColumn("supersedes_run_id", F.lit(None).cast("long"))
    edges = edges.join(runs.select("run_id"), "run_id", "left_semi")
    state = lambda df, s: df.withColumn("state", F.lit(s))
    G.replace_run({"run": state(runs, "first"), "events": state(events, "first"), "edges": state(edges, "first")}, folder)
    few = runs.filter("run_id < 4")
    G.replace_run({"run": state(few, "second"), "events": state(events.filter("run_id < 4 and id % 2 = 0"), "second"), "edges": state(edges.filter("run_id < 0"), "second")}, folder)
    # An attempt that is cut short before its commit changes nothing.
    G.stage_run({"run": state(runs, "lost"), "events": state(events, "lost"), "edges": state(edges, "lost")}, folder, "lost")
    read = lambda kind: G.read_runs(t.spark, folder, kind)
    parts = [read("run").withColumn("id", F.lit(None).cast("long"))] + [read(k) for k in ("events", "edges")]
    rows = [df.select(F.lit(k).alias("kind"), F.col("run_id").cast("long").alias("run_id"), "id", "state") for k, df in zip(("run", "events", "edges"), parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("s12_publish", ["timeline"], """
SELECT event_id, 'zone' AS zone_id, round(confidence, 9) AS confidence, type AS event_type FROM timeline WHERE status = 'accepted' AND n_evidence > 0""")
def s12_publish(t):
    path = new_path(t.spark, "ledger")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    for part in (t("timeline").filter("event_id % 3 = 0"), t("timeline"), t("timeline")):
        G.publish(part, path, "zone", "sensor", at)
    return t.spark.read.parquet(path).select("event_id", "zone_id", F.round("confidence", 9).alias("confidence"), F.get_json_object("payload", "$.event_type").alias("event_type"))


@query("s13_write_replay", ["packets"], " SELECT packet_id, CAST(row_number() OVER (ORDER BY t_device, packet_id) AS BIGINT) AS place FROM packets")
def s13(t):
    from pyspark.sql import Window

    path = new_path(t.spark, "replay")
    G.write_replay(t("packets").select("packet_id", "t_device"), path, ["t_device", "packet_id"])
    lines = t.spark.read.text(path).select(F.get_json_object("value", "$.packet_id").cast("long").alias("packet_id"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    # Places are counted file by file, in the files' order.
    own = lines.withColumn("own", F.row_number().over(Window.partitionBy("file").orderBy("block", "line")))
    sizes = lines.groupBy(F.col("file").alias("of")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a file
    return own.join(before, F.col("file") == F.col("of")).select("packet_id", (F.col("before") + F.col("own")).alias("place"))


@query("s14_append_timeline", ["frames"], " SELECT mission_id, frame_id, t_sec, caption FROM frames WHERE caption IS NOT NULL")
def s14(t):
    source, sink, checkpoint = (new_path(t.spark, name) for name in ("captions", "timeline", "timeline-checkpoint"))
    frames = t("frames").select("mission_id", "frame_id", "t_sec", "caption")
    schema = frames.schema
    for part in (frames.filter("frame_id % 2 = 0"), frames.filter("frame_id % 2 = 1")):  # what came before isn't appended again
        part.write.mode("append").parquet(source)
        T.append_timeline(t.spark.readStream.schema(schema).parquet(source), sink, checkpoint).awaitTermination()
    return t.spark.read.schema(schema).parquet(sink)


def _scripted(batches):
    """A model that counts the letters of a frame's kind, and knows nothing of every seventh mission."""
    for b in batches:
        b = b[b["mission_id"] % 7 != 0]
        yield pd.DataFrame({"mission_id": b["mission_id"], "frame_id": b["frame_id"], "n": b["kind"].str.len().astype("int64")})


@query("u1_providers", ["frames"], """
SELECT mission_id, 'count' AS stage, CASE WHEN mission_id % 7 = 0 THEN 'no_result' ELSE 'ok' END AS code, CASE WHEN mission_id % 7 <> 0 THEN CAST(sum(length(kind)) AS BIGINT) END AS n FROM frames GROUP BY mission_id
UNION ALL SELECT DISTINCT mission_id, 'mask', 'provider_unavailable', CAST(NULL AS BIGINT) FROM frames""")
def u1(t):
    inputs = t("frames").select("mission_id", "frame_id", "kind")
    counts, lacking = V.provided(inputs, "count", "mission_id long, frame_id long, n long", _scripted)
    _, absent = V.provided(inputs, "mask", "mission_id long, frame_id long", None)
    found = counts.groupBy("mission_id").agg(F.sum("n").alias("n")).select("mission_id", F.lit("count").alias("stage"), F.lit("ok").alias("code"), "n")
    return found.unionByName(lacking.unionByName(absent).withColumn("n", F.lit(None).cast("long")))
