"""Repeated passages by sparse suffix arrays.

Only suffixes that start at a minimiser are kept: of every ``WINDOW`` successive
shingles of ``SHINGLE`` words the one with the least hash.  Any passage of
``min_words`` words holds one in its first ``WINDOW`` positions, so two copies
share a retained suffix of at least ``min_words - WINDOW + 1`` words (its
prefix).  Suffixes whose prefix occurs in one document alone are dropped.

Each passage of ``min_words`` words belongs to one minimiser, the same one at the
same distance wherever its words stand.  A suffix keeps the words of the passages
that it owns: up to ``WINDOW - 1`` on its left and ``min_words`` on its right.
Equal ones count once, however many rows hold them.

The suffixes of a prefix are sorted by the words on their right, and each is
compared with its neighbour: suffixes between two neighbours with fewer than
``r`` words in common agree in ``r`` words.  A second order, of the same suffixes
by the words on their left (read backwards), extends the matches: those that also
agree in ``min_words - r`` words on the left share a passage.  All ``WINDOW``
divisions into left and right are looked at, so a neighbour with a longer match
on one side hides none of the others.  Words decide, hashes only bring suffixes
together.

A prefix of more than ``BLOCK`` different suffixes is cut: a suffix goes to one
part for each range of left lengths, keyed by all words that matches of such a
length have in common.  Parts that are still too large are cut down to one
length; then the key is the passage itself, and all suffixes of the part share
it.

Overlapping marks of a document are one span.

Defined cases: null counts as empty; a text of fewer than ``min_words`` words
has no span; rows that repeat id and text are one document; a passage that
repeats in one document alone is no span; white space doesn't matter, letter
case does; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices
from .storage import materialise, release, small

#: Words of a hashed shingle (a power of two), and shingles of which one stays.
SHINGLE, WINDOW = 8, 32
#: Suffixes of a prefix that one task sorts and compares at a time.
BLOCK = 8192
P = 0x9E3779B97F4A7C15


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def run_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, by doubling."""
    done, total, power = 0, None, 1
    part = h
    while power <= length:
        if length & power:
            take = part[done:] if total is None else part[done : done + len(total)]
            n = len(h) - (done + power) + 1
            step = np.uint64(pow(P, power, 1 << 64))
            total = take[:n] if total is None else total[:n] * step + take[:n]
            done += power
        part = part[:-power] * np.uint64(pow(P, power, 1 << 64)) + part[power:] if len(part) > power else part[:0]
        power *= 2
    x = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def owners(h: np.ndarray, min_words: int) -> np.ndarray:
    """The minimiser of each passage of ``min_words`` words: its least shingle, leftmost of equals."""
    if len(h) < min_words:
        return np.empty(0, np.int64)
    n = len(h) - min_words + 1
    at = np.lib.stride_tricks.sliding_window_view(run_hash(h, SHINGLE), WINDOW)[:n].argmin(axis=1)
    return at + np.arange(n)


def anchors(docs: DataFrame, prefix: int, min_words: int) -> DataFrame:
    """(rid, pos, prefix_hash) of every suffix that owns a passage."""

    def batches(it):
        for b in slices(it):
            rid, pos, key = [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = word_hashes(t.encode().split())
                if len(h) < min_words:
                    continue
                at = np.unique(owners(h, min_words))
                pos.append(at)
                key.append(run_hash(h, prefix)[at])
                rid.append(np.full(len(at), r, np.int64))
            joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (rid, pos, key)]
            yield pa.RecordBatch.from_arrays([pa.array(joined[0]), pa.array(joined[1].astype(np.int32)), pa.array(joined[2].astype(np.uint64).view(np.int64))], ["rid", "pos", "prefix_hash"])

    return docs.select("rid", "text").mapInArrow(batches, "rid long, pos int, prefix_hash long")


def suffixes(docs: DataFrame, places: DataFrame, prefix: int, min_words: int) -> DataFrame:
    """(doc_id, rid, pos, ctx, key, left, right): the words that the passages of each place hold.

    ``left`` is read backwards from the place; each word is followed by a space.
    ``ctx`` names equal words on both sides, ``key`` the prefix.
    """
    names = ["doc_id", "rid", "pos", "ctx", "key", "left", "right"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it):
        for b in slices(it, 64):
            columns, size = [[] for _ in names], 0

            def filled(columns=columns, like=b.column(0).type):
                types = [like, pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string()]
                batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                for c in columns:
                    c.clear()
                return batch

            for d, r, t, at in zip(*(c.to_pylist() for c in b.columns)):
                split = t.encode().split()
                h = word_hashes(split)
                own, keys = owners(h, min_words), run_hash(h, prefix).view(np.int64)
                at = np.array(sorted(at))
                for p, x, y in zip(at.tolist(), np.searchsorted(own, at, "left").tolist(), np.searchsorted(own, at, "right").tolist()):
                    left = b"".join(w + b" " for w in reversed(split[x:p]))
                    right = b"".join(w + b" " for w in split[p : y - 1 + min_words])
                    ctx = xxhash.xxh128_digest(left + b"\n" + right)
                    for c, v in zip(columns, (d, r, p, ctx, int(keys[p]), left.decode(), right.decode())):
                        c.append(v)
                    size += len(left) + len(right)
                    if size > 8 << 20:
                        yield filled()
                        size = 0
            yield filled()

    met = docs.join(places.withColumnRenamed("rid", "at_rid"), F.col("rid") == F.col("at_rid")).select("doc_id", "rid", "text", "at")
    return met.mapInArrow(batches, f"doc_id {kind}, rid long, pos int, ctx binary, key long, left string, right string")


def numbered(texts: pa.Array, width: int) -> np.ndarray:
    """A row of word numbers for each text, the same for the same words; -1 after its last word."""
    lists = pc.split_pattern(pc.utf8_slice_codeunits(texts, 0, -1), " ")  # without the last space
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    out = np.full((len(texts), width), -1, np.int32)
    out[np.repeat(np.arange(len(texts)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    out[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = -1
    return out


def common(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many words each row has in common with the row before it; none with one of another group."""
    same = np.zeros(words.shape, bool)
    same[1:] = (words[1:] == words[:-1]) & (words[1:] >= 0) & (group[1:] == group[:-1])[:, None]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def compared(group: np.ndarray, left: pa.Array, right: pa.Array, low: np.ndarray, high: np.ndarray, least: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, least left length, greatest, least id) of the rows that share passages with another document.

    The rows are sorted by group and right; ``low`` and ``high`` bound the documents that hold each.
    """
    n = len(group)
    lefts, rights = numbered(left, WINDOW), numbered(right, min_words)
    n_left, n_right = (lefts >= 0).sum(axis=1), (rights >= 0).sum(axis=1)
    backwards = np.array(sorted(range(n), key=[(g, w.tobytes()) for g, w in zip(group.tolist(), lefts)].__getitem__), np.int64)
    right_lcp, left_lcp = common(rights, group), common(lefts[backwards], group[backwards])
    first, last, best = np.full(n, WINDOW), np.full(n, -1), least.copy()
    for length in range(WINDOW):
        agree = np.empty(n, np.int64)
        agree[backwards] = np.cumsum(left_lcp < length)
        agree += np.cumsum(right_lcp < min_words - length) * (n + 1)
        order = np.flatnonzero((n_left >= length) & (n_right >= min_words - length))
        order = order[np.argsort(agree[order], kind="stable")]
        if not len(order):
            continue
        heads = np.flatnonzero(np.r_[True, np.diff(agree[order]) > 0])
        sizes = np.diff(np.r_[heads, len(order)])
        met = np.repeat(np.minimum.reduceat(low[order], heads) < np.maximum.reduceat(high[order], heads), sizes)
        rows = order[met]
        first[rows], last[rows] = np.minimum(first[rows], length), length
        best[rows] = np.minimum(best[rows], np.repeat(np.minimum.reduceat(least[order], heads), sizes)[met])
    rows = np.flatnonzero(last >= 0)
    return rows, first[rows], last[rows], best[rows]


def neighbours(parts: DataFrame, min_words: int) -> DataFrame:
    """(ctx, first, last, other): left lengths of the passages that suffixes of a key share, from the least to the greatest."""
    kind = parts.schema["first_id"].dataType.simpleString()

    def found(t: pa.Table):
        t = t.combine_chunks()
        key, low, high = (t.column(c).to_numpy() for c in ("key", "low", "high"))
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[heads, len(key)])
        shared = np.repeat(np.minimum.reduceat(low, heads) < np.maximum.reduceat(high, heads), sizes)
        group = np.repeat(np.arange(len(heads)), sizes)[shared]
        t = t.filter(pa.array(shared)).combine_chunks()
        if not t.num_rows:
            return
        ids = t.column("first_id").combine_chunks()
        known = sorted(set(ids.drop_null().to_pylist()))
        rank = {v: k for k, v in enumerate(known)} | {None: len(known)}
        rows, first, last, best = compared(
            group, t.column("left").combine_chunks(), t.column("right").combine_chunks(), low[shared], high[shared], np.array([rank[v] for v in ids.to_pylist()], np.int64), min_words
        )
        known.append(None)
        yield pa.RecordBatch.from_arrays(
            [t.column("ctx").combine_chunks().take(pa.array(rows)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array([known[k] for k in best.tolist()], ids.type)],
            ["ctx", "first", "last", "other"],
        )

    def batches(it):
        held = None
        for b in it:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = held.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1], "left")) if len(key) >= BLOCK else 0
            if whole:  # the last group may go on
                yield from found(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from found(held)

    rows = parts.repartition("key").sortWithinPartitions("key", "right").select("key", "ctx", "low", "high", "first_id", "left", "right")
    return rows.mapInArrow(batches, f"ctx binary, first int, last int, other {kind}")


def shared_passages(parts: DataFrame, min_words: int, block: int) -> list[DataFrame]:
    """Results of :func:`neighbours` of all keys, those of more than ``block`` suffixes cut by longer keys."""
    results, words = [], lambda c: F.length(c) - F.length(F.translate(c, " ", ""))
    for width in (8, 1, 0):
        crowded = parts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select(F.col("key").alias("crowded"))
        crowded = materialise(crowded, "suffix-crowded")
        on = F.col("key") == F.col("crowded")
        if crowded.isEmpty():
            results.append(materialise(neighbours(parts, min_words), "suffix-matches"))
            break
        results.append(materialise(neighbours(parts.join(small(crowded), on, "left_anti"), min_words), "suffix-matches"))
        dealt = parts.join(small(crowded), on).withColumn("part", F.explode(F.sequence(F.floor((min_words - words("right")) / width), F.floor(words("left") / width))))
        start, shared = F.col("part") * width, min_words + 1 - (F.col("part") + 1) * width
        around = [F.call_function("substring_index", F.col(c), F.lit(" "), k.cast("int")) for c, k in (("left", start), ("right", shared))]
        if width == 1:
            passages = dealt.select("ctx", F.col("part").cast("int").alias("length"), F.concat_ws("\n", *around).alias("passage"), "low", "high", "first_id")
            passages = materialise(passages, "suffix-passages")
            held = passages.groupBy(F.col("passage").alias("held")).agg(F.min("low").alias("least"), F.max("high").alias("most"), F.min("first_id").alias("other")).filter("least < most")
            # Written first: a join that reuses the grouping's shuffle couldn't split a passage that very many suffixes hold.
            held = materialise(held.select("held", "other"), "suffix-held")
            met = passages.join(held, F.col("passage") == F.col("held")).select("ctx", F.col("length").alias("first"), F.col("length").alias("last"), "other")
            results.append(materialise(met, "suffix-matches"))
            break
        parts = materialise(dealt.withColumn("key", F.xxhash64("part", "key", *around)).drop("part", "crowded"), "suffix-parts")
    return results


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, block: int = BLOCK) -> DataFrame:
    """One row for each passage of a document that other documents repeat.

    doc_id, start_word, end_word (exclusive), n_words, first_doc_id: the least
    id among the documents that hold a part of the passage.
    """
    if min_words < WINDOW + SHINGLE:
        raise ValueError(f"a passage needs {WINDOW + SHINGLE} words at least")
    prefix = min_words - WINDOW + 1
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    all_anchors = materialise(anchors(rows, prefix, min_words), "suffix-anchors")
    shared = all_anchors.groupBy(F.col("prefix_hash").alias("key")).agg(F.min("rid").alias("low"), F.max("rid").alias("high")).filter("low <> high").select("key")
    # Written first: a join that reuses the grouping's shuffle couldn't split a prefix that a third of the rows hold.
    shared = materialise(shared, "suffix-shared")
    places = all_anchors.join(shared, F.col("prefix_hash") == F.col("key")).groupBy("rid").agg(F.collect_set("pos").alias("at"))
    around = materialise(suffixes(rows, places, prefix, min_words), "suffix-words")
    release(all_anchors, shared)
    distinct = materialise(around.groupBy("key", "ctx", "left", "right").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.min("doc_id").alias("first_id")), "suffix-distinct")
    results = shared_passages(distinct, min_words, block)
    matches = reduce(DataFrame.unionByName, results).groupBy(F.col("ctx").alias("of")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("other").alias("other"))
    matches = materialise(matches, "suffix-extents")  # written first: words that very many rows hold
    release(distinct, *results)
    marks = around.select("doc_id", "rid", "pos", "ctx").join(matches, F.col("ctx") == F.col("of")).select("doc_id", "rid", (F.col("pos") - F.col("last")).alias("start"), (F.col("pos") - F.col("first") + min_words).alias("end"), "other").distinct()
    order = Window.partitionBy("rid").orderBy("start", "end")
    islands = (
        marks.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    spans = islands.groupBy("rid", "island").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.least("other", "doc_id").alias("first_doc_id"))
