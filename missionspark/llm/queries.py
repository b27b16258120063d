"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, html_extract, mixing, order_minhash, secret_scan, sentencepiece_codec, sharding, simhash, suffix_dedup, token_alignment, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id", "group_size")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record as the archives give it back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_passages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    return secret_scan.secret_spans(table(spark, sf_dir, "documents")).drop("found")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal texts stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece numbers of each document, and whether they decode to its text."""
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.load())


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text."""
    return order_minhash.edit_report(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document after a whole shuffle."""
    return sharding.shard_report(table(spark, sf_dir, "documents"), shards=8)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the positives of each anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of the tokens that two tokenizers give each document."""
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mixing, op2_simhash, op3_warc, op4_toxicity, op5_secrets, op6_html, op7_suffixes, op8_exact_dedup, op9_sentencepiece, op10_order_minhash, op11_sharding, op12_hard_negatives, op13_token_alignment, pipeline)
    return {f.__name__: f for f in named}


OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source),
weighted AS (
  SELECT *, ([5, 2, 1])[CAST((rank - 1) % 3 + 1 AS INTEGER)] AS weight, 2.0::DOUBLE * source_size AS cap FROM totals),
levels AS (
  SELECT *, cap / weight AS fill_at,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level_here
  FROM weighted WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, coalesce(least(cap, max(CASE WHEN level_here <= fill_at THEN level_here END) OVER () * weight), cap) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
units AS (
  SELECT s.source, s.key, CAST(sum(s.size) AS BIGINT) AS size, any_value(p.target - p.whole * p.source_size) AS rest
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source, s.key),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM units),
cuts AS (
  SELECT source, min(key) FILTER (WHERE upto > rest) AS cut_key, any_value(rest) - coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS missing FROM ordered GROUP BY source),
extras AS (
  SELECT u.source, min(struct_pack(off := abs(u.size - c.missing), key := u.key)).key AS extra_key
  FROM units u JOIN cuts c ON u.source IS NOT DISTINCT FROM c.source
  WHERE u.key >= c.cut_key AND u.size > 0 AND abs(u.size - c.missing) < c.missing GROUP BY u.source),
drawn AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target,
         CAST(p.whole + CASE WHEN p.target - p.whole * p.source_size > 0 AND (s.key < c.cut_key OR coalesce(s.key = e.extra_key, false)) THEN 1 ELSE 0 END AS INTEGER) AS repeats
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
  LEFT JOIN extras e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, repeats, size * repeats AS taken FROM drawn
"""

OP3_SQL = """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest
  FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM named
"""

OP8_SQL = """
WITH texts AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""

OP12_SQL = """
WITH used AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256::DOUBLE * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id OR a.label <> b.label WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op3_warc": OP3_SQL, "op8_exact_dedup": OP8_SQL, "op12_hard_negatives": OP12_SQL}
