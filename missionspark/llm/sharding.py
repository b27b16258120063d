"""Sharding by a two-pass external shuffle.

The first pass scatters the records uniformly into buckets that fit in memory:
a seeded hash of a record's content and of its place in its file names the
bucket, so that copies of one text, and even rows repeated whole, spread like
all others.  The second pass takes one bucket at a time, puts its records in a
defined order and applies a seeded Fisher-Yates shuffle.  The buckets one after
the other are the shuffled table: a record's position is the number of records
in the buckets before its own plus its place in it.

The law of the shards is ``rows``: shard ``k`` of ``n`` holds the positions from
``floor(k * rows / n)`` to ``floor((k + 1) * rows / n)``, so that the counts are at
most one apart, slots have no gaps, and a bucket is written to one or two shards.

A bucket is one partition, and the shuffle's generator starts from the seed and
the partition's number: a task that is run again, or another run over the same
files with the same options, gives the same order on any cluster.

Only DataFrame operations run on the executors.

Defined cases: null text has no bytes and checksum 0; null and repeated
identifiers are rows like any other, repeated rows get positions of their own;
with fewer rows than shards some shards are empty; an empty table gives an empty
result; input columns with any name are kept in ``doc`` by :func:`write_shards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import located
from .storage import materialise, small

#: Bytes of a bucket, bytes that a record without its text counts, and the least number of buckets.
BUCKET_BYTES, SLIM_BYTES, LEAST_BUCKETS = 32 << 20, 64, 16
#: Buckets whose offsets are summed in one task.
TOGETHER = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def scatter(records: DataFrame, buckets: int, seed: int) -> DataFrame:
    """First pass: records, keyed by content and place, dealt to one partition a bucket."""
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "at.row")
    return records.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int")).repartitionById(buckets, "bucket")


def shuffle_buckets(scattered: DataFrame, seed: int) -> DataFrame:
    """Second pass: (bucket, place, record) after a Fisher-Yates shuffle of each bucket."""
    names = [c for c in scattered.columns if c != "bucket"]
    ordered = scattered.sortWithinPartitions("bucket", "doc_id", "text_crc32", "size", "at")
    gathered = ordered.groupBy("bucket").agg(F.collect_list(F.struct(*names)).alias("records"))
    mixed = gathered.select("bucket", F.shuffle("records", seed).alias("records"))
    return mixed.select("bucket", F.posexplode("records").alias("place", "record"))


def offsets(mixed: DataFrame) -> DataFrame:
    """(of, before): the records in the buckets before each one, summed in two levels."""
    counts = mixed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("chapter", F.floor(F.col("bucket") / TOGETHER))
    counts = materialise(counts, "shard-counts")
    upto = lambda over, order: F.coalesce(F.sum("n").over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chapters = counts.groupBy("chapter").agg(F.sum("n").alias("n")).select(F.col("chapter").alias("in_chapter"), upto(Window.partitionBy(F.lit(0)), "chapter").alias("chapter_before"))
    inside = counts.select("bucket", "chapter", upto(Window.partitionBy("chapter"), "bucket").alias("inside_before"))
    return inside.join(chapters, F.col("chapter") == F.col("in_chapter")).select(F.col("bucket").alias("of"), (F.col("chapter_before") + F.col("inside_before")).alias("before"))


def shuffled(docs: DataFrame, shards: int = 8, *, seed: int = 29, doc_id: str = "doc_id", text: str = "text", whole: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row with its place: doc_id, size, text_crc32, shard, slot, and ``doc`` if whole rows are shuffled.

    Without ``whole`` the texts stay where they are read and only identifier,
    size and checksum move.
    """
    content = F.coalesce(F.col("doc")[text], F.lit(""))
    carried = [F.col("doc")[doc_id].alias("doc_id"), size_of(F.col("doc")[text]).alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"), F.struct(F.col("locator.row").alias("row"), F.col("locator.file").alias("file")).alias("at")]
    records = located(docs).select(*carried, *(["doc"] if whole else []))
    weight = F.sum(F.col("size") if whole else F.lit(0)) + F.count("*") * SLIM_BYTES
    buckets = max(LEAST_BUCKETS, -(-(records.agg(weight.alias("bytes")).first().bytes or 0) // bucket_bytes))
    mixed = materialise(shuffle_buckets(scatter(records, buckets, seed), seed), "shard-records")
    starts = materialise(offsets(mixed), "shard-offsets")
    placed = mixed.join(small(starts), F.col("bucket") == F.col("of")).withColumn("position", F.col("before") + F.col("place"))
    rows = mixed.count()
    # Integer division: the shard k with floor(k * rows / shards) <= position < floor((k + 1) * rows / shards).
    shard = F.expr(f"int(((position + 1) * {shards}L - 1) div {rows}L)").alias("shard")
    return placed.select("record.*", "position", shard).withColumn("slot", F.expr(f"position - (shard * {rows}L) div {shards}L")).drop("position", "at")


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Writes whole rows as Parquet: folder ``shard=k`` with (slot, doc), in the order of the slots in each file."""
    placed = shuffled(docs, shards, whole=True, **options).select("shard", "slot", "doc")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law moves rows when shards are added)."""
    placed = shuffled(docs, shards, **options)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
