"""Document fingerprints by Order MinHash.

A text is its k-mers of code points, each numbered by its occurrence, so that
repeats count.  Each slot takes the two k-mers that its hash puts first, puts
them back in text order and hashes the pair.  Two texts agree in a slot
only if they share these k-mers and their order, which follows the edit
distance where a set of k-mers would not.

Defined cases: null counts as empty, and all empty texts agree in every slot; a
text shorter than a k-mer is one k-mer, which then fills both places of a pair; equal texts have equal fingerprints; rows that repeat follow
each other in order of their text's digest; a table of one row is its own next
document; ids are of any ordered type, null ids come last; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SLOTS = 8, 64
P = 0x9E3779B97F4A7C15
#: Each slot orders the hashes by a product of its own: odd factors drawn with a fixed seed.
FACTORS = np.random.default_rng(20).integers(0, 1 << 64, SLOTS, dtype=np.uint64) | np.uint64(1)
#: Hashes that all slots order at once; of more, slot by slot.
AT_ONCE = 1 << 13
_POWERS = [np.uint64(pow(P, 1 << j, 1 << 64)) for j in range(K.bit_length())]
#: Low bits of a sorted hash that hold the place of its k-mer.
PLACE = 20
#: Rows of a bucket of the id order, which one task sorts and reads as a stream, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 20_000, 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def kmers(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each k-mer, in text order; a shorter text is one k-mer."""
    h = points.astype(np.uint64) + np.uint64(1)
    if len(h) < K:
        total = np.uint64(len(h))
        for x in h:
            total = np.uint64((int(total) * P + int(x)) & ((1 << 64) - 1))
        return _mix(np.array([total], np.uint64))
    for j in range(K.bit_length() - 1):  # K is a power of two: double the length
        h = h[: -(1 << j)] * _POWERS[j] + h[1 << j :]
    return _mix(h)


def ordered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in ascending order and their places; equal hashes by place."""
    if len(h) >> PLACE:
        place = np.argsort(h, kind="stable")
        return h[place], place
    low = np.uint64((1 << PLACE) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    return packed & ~low, (packed & low).astype(np.int64)


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k-mer, occurrence), ascending, and their places."""
    h = h & ~np.uint64((1 << PLACE) - 1)  # alike for texts of any length
    s, place = ordered(h)
    again = np.r_[False, s[1:] == s[:-1]]
    if again.any():
        at = np.arange(len(s))
        nth = at - np.maximum.accumulate(np.where(again, 0, at))
        repeats = np.flatnonzero(nth)
        h[place[repeats]] = _mix(s[repeats] + nth[repeats].astype(np.uint64) * np.uint64(P)) & ~np.uint64((1 << PLACE) - 1)
        s, place = ordered(h)
    return s, place


def least_two(x: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least and the second least of the hashes in the order of each slot; of equals the first.

    Of one hash both are its place.
    """
    keys = x * factors[:, None]
    rows = np.arange(len(factors))
    first = keys.argmin(axis=1)
    if len(x) == 1:
        return first, first
    keys[rows, first] = np.uint64((1 << 64) - 1)
    second = keys.argmin(axis=1)
    return first, np.where(second == first, (first + 1) % len(x), second)


def fingerprint(text: str) -> np.ndarray:
    """The slots of a text, 16 bits each.

    A slot takes the two occurrence-numbered k-mers that its own order puts
    first, puts them back in the order of the text and hashes the pair.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return np.zeros(SLOTS, np.uint16)
    x, place = numbered(kmers(points))
    if len(x) <= AT_ONCE:
        first, second = least_two(x, FACTORS)
    else:
        first, second = (np.concatenate(c) for c in zip(*(least_two(x, FACTORS[k : k + 1]) for k in range(SLOTS))))
    swap = place[first] > place[second]
    early, late = x[np.where(swap, second, first)], x[np.where(swap, first, second)]
    return (_mix(_mix(early) * np.uint64(3) + _mix(late + np.uint64(1)) + np.arange(SLOTS, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots."""
    return float((a == b).mean())


def as_text(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by the first as many of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each document."""

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_text(fingerprint(t or "")) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, f"doc_id {kind}, fingerprint string")


def position(value, bounds: list):
    """How many of the ascending bounds are at most ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    known = F.lit(bounds)
    span = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")

    def halve(s, _):
        at = middle(s)
        right = (s["low"] < s["high"]) & (F.get(known, at) <= value)
        return F.struct(F.when(right, at + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(at).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), span, halve)["low"]


def in_id_order(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """Rows (bucket, after, doc_id, text) sorted by descending id in each bucket.

    Each bucket ends with a copy of the row that follows it in the whole order
    (``after``), so a task knows the next document of all its rows.  The text
    is shuffled once.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The ids alone are dealt by range first; the least id of each range is one bound, so bounds follow the rows and are few.
    ids = docs.select(F.col(doc_id).alias("doc_id")).filter("doc_id is not null").repartitionByRange(buckets, "doc_id")
    bounds = sorted(r.least for r in ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least")).collect()) if buckets > 1 else []
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(position(F.col("doc_id"), bounds))).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one row for each bucket, 65,537 at most
    heads = heads.select(
        F.col("bucket").alias("of"), F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"),
        F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(order)).alias("also"),
    )
    met = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    copies = F.when(F.col("also").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("after")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(False).alias("after")), F.struct(F.col("also").alias("bucket"), F.lit(True).alias("after")))
    )
    dealt = met.select(F.explode(copies).alias("to"), "doc_id", "text", "tie").select("to.bucket", "to.after", "doc_id", "text", "tie")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "after", F.desc_nulls_last("doc_id"), F.desc("tie")).select("bucket", "after", "doc_id", "text")


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document, compared with its edited text and the next document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_id_order(docs, doc_id, text, min(MAX_BUCKETS, max(8 * parts, docs.count() // BUCKET_ROWS)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def batches(it):
        last = None  # (bucket, doc_id, text, fingerprint), without its next yet
        for b in it:
            out = []
            for bucket, after, own_id, own in zip(*(c.to_pylist() for c in b.columns)):
                if last is None and after:
                    continue  # a further copy of the row that follows
                f = fingerprint(own)
                if last is not None and last[0] == bucket:
                    _, seen_id, seen, seen_f = last
                    changed = edited(seen, own)
                    changed_f = fingerprint(changed)
                    out.append((seen_id, len(seen), hashlib.sha256(changed.encode()).hexdigest(), as_text(seen_f), as_text(changed_f), likeness(seen_f, changed_f), likeness(seen_f, f)))
                last = None if after else (bucket, own_id, own, f)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.select(F.col(doc_id)).schema[0].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return dealt.mapInArrow(batches, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
