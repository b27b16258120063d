"""WARC archives: writing with revisits, and reading by boundary chains.

Written archives hold one record a page.  Payloads are grouped by digest; the
page with the least id holds the bytes and the others are revisits of it.

A reader can't trust the magic ``WARC/1.``: a payload may hold it.  Tasks split
the files at the magic and emit each candidate record with the offset where it
says that its successor starts.  Pointer jumping from the file's start, which
doubles the reach of every pointer in each round, retains the records that the
chain reaches; what else looked like a record lies inside a payload, and the
pieces of such a payload are put together again, in a second scan of their files
that finds each piece by its byte offset.

Defined cases: null html is an empty payload; payloads shorter than
``least_bytes`` are responses all; rows that repeat page and payload are all
responses where the id is the least; page ids are of any ordered type, and text
is percent-encoded in a record's name; a null page id comes after all others and
is null when read; line ends in a url are percent-encoded; an empty table gives
archives without a record and an empty result; other columns are not written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import discard, materialise, new_path

# Fixed values of the format.
MAGIC, LINE, END = "WARC/1.", "\r\n", "\r\n\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NO_PAGE = "<urn:page>"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads that are broadcast (28 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 500_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: eight digits for every five bytes."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def records(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """(value): one record a page, as it stands in the archive."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    groups = (
        rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
        .select(F.unhex("digest").alias("of"), "first_id")
    )
    groups = materialise(groups, "warc-groups")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)  # the pages then stay where they are read
    met = rows.join(groups, F.unhex("digest") == F.col("of"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")) & (F.octet_length("html") >= least_bytes)
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("html")))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))

    encoded = F.url_encode if rows.schema["page_id"].dataType.typeName() == "string" else lambda c: c.cast("string")
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), encoded(F.col(c)), F.lit(">")), F.lit(NO_PAGE))
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"{MAGIC}1{LINE}"), header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), header("WARC-Record-ID", name("page_id")),
        F.coalesce(header("WARC-Target-URI", clean), F.lit("")), header("WARC-Date", F.lit("1970-01-01T00:00:00Z")), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))),
        F.when(revisit, F.concat(header("WARC-Refers-To", name("first_id")), header("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        header("Content-Type", F.lit("application/http; msgtype=response")), header("Content-Length", F.octet_length(block).cast("string")), F.lit(LINE),
    )
    return met.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> None:
    """Writes the archives below ``path``, one for each task."""
    records(pages, page_id, url, html, least_bytes).write.option("lineSep", END).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, value, size): the files cut at the magic, in order."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value", F.octet_length("value").cast("long").alias("size"))


def headers(value: Column) -> dict[str, Column]:
    """What the header of a candidate says; null length if it isn't a header."""
    head = F.substring_index(value, END, 1)
    ok = head.rlike(r"^[01]\r\n") & value.contains(END)
    field = lambda name, pattern: F.nullif(F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*({pattern})[ \t]*(?:\r\n|$)", 1), F.lit(""))
    return {
        "length": F.when(ok, field("Content-Length", r"\d{1,15}").cast("long")), "head_bytes": F.octet_length(head).cast("long") + len(END),
        "type": field("WARC-Type", r"[^\r]*?"), "record": field("WARC-Record-ID", r"[^\r]*?"), "refers": field("WARC-Refers-To", r"[^\r]*?"), "said": field("WARC-Payload-Digest", r"[^\r]*?"),
        "http": field("Content-Type", r"[^\r]*?").startswith("application/http"),
    }


def placed(spark: SparkSession, path: str) -> DataFrame:
    """Candidates with their byte offset, successor and, where whole, their payload's size and digest."""
    rows = candidates(spark, path)
    heads = headers(F.col("value"))
    rows = rows.select("file", "split", "seq", "size", F.col("value").cast("binary").alias("bytes"), *[c.alias(k) for k, c in heads.items()])
    block = F.substring(F.col("bytes"), (F.col("head_bytes") + 1).cast("int"), F.col("length").cast("int"))
    whole = F.col("size") >= F.col("head_bytes") + F.col("length")
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(False)))
    rows = rows.withColumn("payload", F.when(F.col("whole"), payload_of(block, F.col("http"))))
    slim = rows.select("file", "split", "seq", "size", "length", "head_bytes", "type", "record", "refers", "said", "http", "whole", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))
    slim = materialise(slim, "warc-candidates")
    # Where a split's first piece starts: the pieces of the splits before it, and the magic behind each.
    sums = slim.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("all"))
    begins = sums.select(F.col("file").alias("in_file"), F.col("split").alias("in_split"), F.coalesce(F.sum("all").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    here = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("inside", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(here), F.lit(0)))
    rows = rows.join(begins, (F.col("file") == F.col("in_file")) & (F.col("split") == F.col("in_split"))).withColumn("piece_at", F.col("begin") + F.col("inside"))
    rows = rows.withColumn("at", F.col("piece_at") - len(MAGIC))
    return materialise(rows.withColumn("next", F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END)).drop("inside", "in_file", "in_split", "begin"), "warc-placed")


def payload_of(block: Column, http: Column) -> Column:
    """The payload of a record's block: behind the HTTP header if it has one."""
    head = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
    return F.when(F.coalesce(http, F.lit(False)) & block.cast("string").startswith("HTTP/"), F.substring(block, head + 1, 2147483647)).otherwise(block)


def reachable(links: DataFrame) -> DataFrame:
    """Links (file, at, next) to the rows (file, at) that a chain from offset 0 reaches.

    Each round marks what the marked rows point at and doubles every pointer, so
    the rounds grow with the logarithm of a file's records.
    """
    spark = links.sparkSession
    known = links.select("file", "at")
    start = links.join(known.withColumnsRenamed({"file": "known_file", "at": "known_at"}), (F.col("file") == F.col("known_file")) & (F.col("next") == F.col("known_at")), "left").select("file", "at", F.col("known_at").alias("next"), (F.col("at") == 0).alias("on"))
    path = new_path(spark, "warc-chain")
    start.write.parquet(path)
    schema = start.schema
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1))):
        state = spark.read.schema(schema).parquet(path)
        far = state.select(F.col("file").alias("far_file"), F.col("at").alias("far_at"), F.col("next").alias("far_next"))
        marks = state.filter("on and next is not null").select(F.col("file").alias("mark_file"), F.col("next").alias("mark_at")).distinct()
        step = (
            state.join(far, (F.col("file") == F.col("far_file")) & (F.col("next") == F.col("far_at")), "left")
            .join(marks, (F.col("file") == F.col("mark_file")) & (F.col("at") == F.col("mark_at")), "left")
            .select("file", "at", F.col("far_next").alias("next"), (F.col("on") | F.col("mark_at").isNotNull()).alias("on"))
        )
        old, path = path, new_path(spark, "warc-chain")
        step.write.parquet(path)
        discard(spark, old)
    return spark.read.schema(schema).parquet(path).filter("on").select("file", "at")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: file, at, type, record, refers, said, payload_bytes, digest."""
    rows = placed(spark, path)
    chain = reachable(rows.filter("length is not null").select("file", "at", "next"))
    on = chain.select(F.col("file").alias("on_file"), F.col("at").alias("on_at"))
    found = rows.join(on, (F.col("file") == F.col("on_file")) & (F.col("at") == F.col("on_at"))).drop("on_file", "on_at")
    columns = ["file", "at", "type", "record", "refers", "said", "payload_bytes", "digest"]
    parted = found.filter("not whole")
    if parted.isEmpty():
        return found.select(columns)
    # Payloads that hold the magic: their pieces, in order, with the magic between.
    owners = parted.select(F.col("file").alias("own_file"), F.col("at").alias("own_at"), "next", "length", "head_bytes", "type", "record", "refers", "said", "http")
    inside = rows.select("file", "piece_at").join(owners.select("own_file", "own_at", "next"), (F.col("file") == F.col("own_file")) & (F.col("piece_at") > F.col("own_at")) & (F.col("piece_at") < F.col("next")))
    # The scan may cut the files elsewhere than the first one did, so pieces are known by their place in the file.
    wanted = materialise(owners.select(F.col("own_file").alias("of")).distinct(), "warc-parted")
    again = candidates(spark, path).join(wanted, F.col("file") == F.col("of"), "left_semi")
    before = Window.partitionBy("file").orderBy("split", "seq").rowsBetween(Window.unboundedPreceding, -1)
    again = again.withColumn("offset", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before), F.lit(0)))
    pieces = again.select(F.col("file").alias("piece_file"), "offset", "value").join(inside, (F.col("piece_file") == F.col("file")) & (F.col("offset") == F.col("piece_at")))
    joined = pieces.groupBy("own_file", "own_at").agg(F.array_sort(F.collect_list(F.struct("piece_at", "value"))).alias("list"))
    text = F.array_join(F.transform("list", lambda x: x.getField("value")), MAGIC).cast("binary")
    mended = joined.withColumn("bytes", text).withColumnsRenamed({"own_file": "file", "own_at": "at"}).join(owners.withColumnsRenamed({"own_file": "f", "own_at": "a"}), (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")))
    block = F.substring(F.col("bytes"), (F.col("head_bytes") + 1).cast("int"), F.col("length").cast("int"))
    mended = mended.withColumn("payload", payload_of(block, F.col("http"))).select("file", "at", "type", "record", "refers", "said", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))
    return found.filter("whole").select(columns).unionByName(mended)


def page_number(record: str, kind: str) -> Column:
    """The page id in a record's name; null for a page without one."""
    found = F.when(F.col(record).startswith("<urn:page:"), F.regexp_extract(record, "<urn:page:(.*)>", 1))
    return F.url_decode(found) if kind == "string" else found.cast(kind)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives and reads them back.

    One row a record: page_id, payload_bytes, payload_digest, record_type,
    refers_to, intact (the bytes read have the digest that the header says).
    A revisit has the size and digest of the payload that it refers to.
    """
    spark = pages.sparkSession
    kind = pages.select(F.col(page_id)).schema[0].dataType.simpleString()
    path = new_path(spark, "warc")
    write_archives(pages, path, page_id=page_id, url=url, html=html, least_bytes=least_bytes)
    found = materialise(read_archives(spark, path), "warc-records")
    full = found.filter("type = 'response'").groupBy(F.col("record").alias("full")).agg(F.min("payload_bytes").alias("full_bytes"), F.min("digest").alias("full_digest"))
    full = materialise(full, "warc-full")  # written first: a join that reuses this shuffle couldn't split a payload that very many pages hold
    rows = found.filter("type = 'revisit'").join(full, F.col("refers") == F.col("full"), "left").select("type", "record", "refers", "said", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("digest"))
    rows = rows.unionByName(found.filter("type = 'response'").select("type", "record", "refers", "said", "payload_bytes", "digest"))
    return rows.select(
        page_number("record", kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        page_number("refers", kind).alias("refers_to"), (F.col("said") == F.concat(F.lit("sha1:"), F.col("digest"))).alias("intact"),
    )
