"""Exact deduplication with keyed streaming state.

A log of arrivals (digest, identifier, locator) is read as a stream and grouped
by digest in the disk-backed RocksDB state store.  There is no watermark, so a
key never expires: with a ``store`` folder, log, state and checkpoint outlive the
call, and a text that comes back years later still meets its first digest.  The
state of a key holds the number of rows, the stable identifier that stays and
the locator of its content: file and row.

Where a digest is hit again, the full bytes of the row are compared with those
at the locator that stays, which may lie in a file of an earlier call; a row
with other bytes leaves the group and forms one by its own bytes, among the rows
of its call.

Only DataFrame operations run on the executors.

Defined cases: null text counts as empty, and all empty texts are equal; of
equal texts the row with the largest identifier stays, null identifiers last;
of rows that repeat identifier and text exactly one stays; an empty table gives
an empty result; other columns of the input are never read; with a store the
answers are for the rows of the call, after them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise, new_path, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Each store preallocates some megabytes of disk, so their number follows the keys and not the shuffles.
    "spark.sql.streaming.internal.stateStore.partitions": None,
}
#: Arrivals for each state store; there are as many stores as cores at least.  A store folder keeps the number of its first call.
STORE_ROWS = 50_000


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only.  Text of one byte a character takes the fast way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


#: Input files of earlier calls that are looked into at a time.
FILES = 1000


def scan_alone(docs: DataFrame) -> bool:
    """Whether the rows are those of files, each at most once: a scan with filters and projections, no join or explode."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().apply(0)
    if node.nodeName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    distinct = docs.sparkSession._jsparkSession.baseRelationToDataFrame(node.relation()).inputFiles()
    return len(distinct) == len(node.relation().location().inputFiles())


def located(docs: DataFrame) -> DataFrame:
    """The documents with ``locator`` (file, row) beside their columns in ``doc``.

    Rows that don't come straight from Parquet files are written to some first.
    """
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    try:
        if scan_alone(docs):
            return docs.select(doc, locator)
    except AnalysisException:  # files of another kind
        pass
    return materialise(docs, "dedup-content").select(doc, locator)


def arrivals(rows: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Log of (doc_id, locator, digest)."""
    return rows.select(F.col("doc")[doc_id].alias("doc_id"), "locator", digest(normalised(F.col("doc")[text])).alias("digest"))


def stream_state(spark: SparkSession, log_path: str, log: DataFrame, store: str, files_per_batch: int | None = None) -> DataFrame:
    """Runs what is new in the log through the keyed state; the last state of each digest that it met.

    The query goes on from the checkpoint in the store, so a batch that was cut
    short is done again from the last committed state.
    """
    state_path = new_path(spark, "dedup-state")
    reader = spark.readStream.schema(log.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    best = F.max(F.struct("doc_id", "locator")).alias("best")
    grouped = reader.parquet(log_path).groupBy("digest").agg(F.count("*").alias("n"), best)
    stores = max(spark.sparkContext.defaultParallelism, -(-log.count() // STORE_ROWS))
    options = {k: v or str(stores) for k, v in STORE.items()}
    was = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        query = (
            grouped.writeStream.outputMode("update").option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True)
            .foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{state_path}/batch={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = grouped.schema
    if query.lastProgress is None:  # nothing has ever arrived
        return spark.createDataFrame([], schema)
    changes = spark.read.schema(schema.add("batch", "long")).parquet(state_path)
    if not files_per_batch:
        return changes.drop("batch")  # availableNow has handed over the log in one batch
    return changes.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "batch").alias("last")).select("digest", "last.*")


def strangers(rows: DataFrame, state: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Rows of a hit digest whose bytes differ from those at the locator that stays: (locator, digest, own).

    ``own`` identifies the row's bytes by another digest.
    """
    spark = rows.sparkSession
    hits = materialise(state.filter("n > 1").select(F.col("digest").alias("hit"), F.col("best.locator").alias("keeps")), "dedup-hit")
    own = rows.select("locator", normalised(F.col("doc")[text]).alias("bytes")).withColumn("digest", digest(F.col("bytes")))
    met = materialise(own.join(small(hits), F.col("digest") == F.col("hit")).drop("hit"), "dedup-hits")
    # Written first: a join that reuses this shuffle couldn't split a text that a third of the rows hold.
    stays = materialise(met.filter(F.col("locator") == F.col("keeps")).select(F.col("digest").alias("of"), F.col("bytes").alias("kept_bytes")), "dedup-stays")
    earlier = hits.join(stays, F.col("hit") == F.col("of"), "left_anti")
    files = (r.file for r in earlier.select(F.col("keeps.file").alias("file")).distinct().toLocalIterator())  # input files of earlier calls
    while block := list(islice(files, FILES)):
        content = spark.read.parquet(*block).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"), normalised(F.col(text)).alias("kept_bytes"))
        stays = stays.unionByName(earlier.join(content, F.col("keeps") == F.col("at")).select(F.col("hit").alias("of"), "kept_bytes"))
    others = met.join(stays, F.col("digest") == F.col("of")).filter(F.col("bytes") != F.col("kept_bytes"))
    return others.select("locator", "digest", F.sha2("bytes", 512).alias("own"))


def decisions(rows: DataFrame, doc_id: str, text: str, files_per_batch: int | None, store: str | None, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, locator, keep_id, group_size, kept, text_sha256) of located rows."""
    spark = rows.sparkSession
    store = store or new_path(spark, "dedup-store")
    log = arrivals(rows, doc_id, text, digest)
    path = new_path(spark, "dedup-arrivals")
    log.write.parquet(path)
    log = spark.read.schema(log.schema).parquet(path)
    log.write.mode("append").parquet(f"{store}/log")
    state = stream_state(spark, f"{store}/log", log, store, files_per_batch)
    odd = materialise(strangers(rows, state, doc_id, text, digest), "dedup-strangers")
    found = log.join(state.withColumnRenamed("digest", "key"), F.col("digest") == F.col("key")).drop("key")
    answer = lambda n, best: (
        F.col("doc_id"), F.col("locator"), best.getField("doc_id").alias("keep_id"), n.alias("group_size"),
        (F.col("locator") == best.getField("locator")).alias("kept"), F.col("digest").alias("text_sha256"),
    )
    if odd.isEmpty():
        return found.select(*answer(F.col("n"), F.col("best")))
    # Groups of strangers by their bytes; the others are as many less.
    parts = odd.withColumnsRenamed({"locator": "odd_at", "digest": "odd_digest"})
    split = found.join(parts, F.col("locator") == F.col("odd_at"), "left")
    by_bytes = materialise(split.filter("own is not null").groupBy("digest", "own").agg(F.count("*").alias("own_n"), F.max(F.struct("doc_id", "locator")).alias("own_best")).withColumnsRenamed({"digest": "d", "own": "o"}), "dedup-own")
    gone = materialise(by_bytes.groupBy(F.col("d").alias("g")).agg(F.sum("own_n").alias("gone")), "dedup-gone")
    split = split.join(by_bytes, (F.col("digest") == F.col("d")) & (F.col("own") == F.col("o")), "left").join(gone, F.col("digest") == F.col("g"), "left")
    return split.select(*answer(F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0))), F.coalesce("own_best", "best")))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", files_per_batch: int | None = None, store: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row a document: doc_id, locator, keep_id, group_size, kept, text_sha256.

    ``store`` names a shared folder that keeps the state for later calls, whose
    documents then meet those of all calls before; without it the state is of
    this call alone.  Files that hold kept content must stay readable.
    """
    return decisions(located(docs), doc_id, text, files_per_batch, store, digest)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", store: str | None = None) -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = located(docs)
    gone = materialise(decisions(rows, doc_id, text, None, store, sha256).filter("not kept").select(F.col("locator").alias("gone")), "dedup-dropped")
    return rows.join(small(gone), F.col("locator") == F.col("gone"), "left_anti").select("doc.*")
