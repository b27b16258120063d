"""SimHash near-duplicates, searched in shards of Burkhard-Keller trees.

A fingerprint has 64 bits; a bit is set where more than half of the hashes of
the document's word shingles have it.  Two fingerprints within ``radius`` bits
that are cut into ``radius + 1`` blocks agree in one block at least, so each
fingerprint goes to one shard for each block value, and every link lies inside
a shard.  A shard is a BK-tree: a child hangs on its parent by the integer
Hamming distance, and a search follows only edges within the radius.

The trees are dealt by shard key instead of being broadcast: all trees together
grow with the corpus, and no broadcast of them has a bound.  Exact copies share
one fingerprint and count once.  A shard above ``shard_rows`` is cut again by
the blocks of its remaining bits; after three cuts at most 2**19 fingerprints
can share a key, which bounds every tree.

Sixty-four bits tell a Jaccard similarity of 0.8 badly (pairs differ in 4 to 17
bits), so for a similarity the fingerprint has 256 bits of the distinct shingles,
the shards come from least shingles, and what links there is compared exactly,
by shingle sets; see :func:`similar_links`.  Both ways give edges that join the
groups and not all pairs; the edges' connected components are the groups.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and is linked like any other; a text of fewer words than a shingle has one
shingle, its words; rows that repeat keep one fingerprint each; null ids are
never the smallest id of a group unless all are null; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import lean, slices
from .components import components
from .storage import materialise, release, small

BITS = 64
UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included, as unsigned integers."""
    # bytes.split() cuts at space and 0x09-0x0D, the white space that is meant.
    tokens = (text or "").encode().translate(UPPER_TO_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) < words:
        return np.array([digest(join(tokens), seed)], np.uint64)
    return np.array([digest(join(s), seed) for s in zip(*(tokens[k:] for k in range(words)))], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, from the highest bit on."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that over half of the hashes have."""
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes)).view(">u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row for each document."""

    def batches(it):
        for b in it:
            fps = [majority(shingle_hashes(t, words)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(batches), f"doc_id {kind}, fp long")


class Tree:
    """A BK-tree of one shard: children keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius:
                open_nodes += [c for d, c in children.items() if -radius <= d - distance <= radius]
            else:
                open_nodes += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]
        return found

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)
        return new


def shard_edges(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (value, root) that join the distinct values linked inside a shard."""
    tree, root = Tree(), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for value in values:
        hits = tree.near(value, radius)
        own = tree.add(value)
        root.append(own)
        for h in hits:
            a, b = top(h), top(own)
            root[max(a, b)] = min(a, b)
    return [(tree.values[x], tree.values[top(x)]) for x in range(len(root)) if top(x) != x]


def blocks(bits: list[int], count: int) -> list[list[int]]:
    """Cuts the bit positions into ``count`` blocks of nearly equal length."""
    ends = [round(len(bits) * k / count) for k in range(count + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:])]


def shards(fps: DataFrame, radius: int, shard_rows: int, cuts: int = 3) -> DataFrame:
    """(key, fp): each fingerprint in the shards that may hold its neighbours."""

    def masks(free: list[int], fixed: int, left: int) -> list[list[int]]:
        """Masks of the key bits, for all ways to cut ``left`` more times."""
        found = []
        for block in blocks(free, radius + 1):
            mask = fixed | sum(1 << b for b in block)
            found.append([mask] if left == 1 else None)
            if left > 1:
                found[-1:] = masks([b for b in free if b not in block], mask, left - 1)
        return found

    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m

    def keyed(rows: DataFrame, level: int) -> DataFrame:
        """Shards of this level; below the first, only inside the hot shard's mask."""
        ways = [signed(m[0]) for m in masks(list(range(BITS)), 0, level)]
        if level == 1:
            wide = rows.select("fp", F.explode(F.array(*map(F.lit, ways))).alias("mask"))
        else:
            step = radius + 1
            parents = [signed(m[0]) for m in masks(list(range(BITS)), 0, level - 1)]
            finer = F.create_map(*[x for p, parent in enumerate(parents) for x in (F.lit(parent), F.array(*map(F.lit, ways[p * step : (p + 1) * step])))])
            wide = rows.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
        return wide.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))

    done, rows = None, fps.select("fp")
    for level in range(1, cuts + 1):
        at = keyed(rows, level)
        # Written first: a join that reuses the grouping's shuffle couldn't split a hot key.
        size = materialise(at.groupBy(F.col("key").alias("sized")).agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
        at = at.join(size, F.col("key") == F.col("sized")).drop("sized")
        if level < cuts:
            at = materialise(at, "simhash-shards")
            cold, rows = at.filter(F.col("n") <= shard_rows), at.filter(F.col("n") > shard_rows)
        else:
            cold, rows = at, None
        cold = cold.select("key", "fp")
        done = cold if done is None else done.unionByName(cold)
        if rows is None or rows.isEmpty():
            break
    return done


def links(fps: DataFrame, radius: int = 2, shard_rows: int = 4096) -> DataFrame:
    """Edges (u, v) between distinct fingerprints; their components are the groups."""

    def batches(it):
        key, values = None, []
        for b in it:
            keys, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            us, vs = [], []
            for a, z in zip(starts, [*starts[1:], len(keys)]):
                if keys[a] != key:
                    for u, v in shard_edges(values, radius) if len(values) > 1 else ():
                        us.append(u)
                        vs.append(v)
                    key, values = keys[a], []
                values += fp[a:z].view(np.uint64).tolist()
            yield edges(us, vs)
        found = shard_edges(values, radius) if len(values) > 1 else []
        yield edges([u for u, _ in found], [v for _, v in found])

    def edges(us: list[int], vs: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], ["u", "v"])

    dealt = shards(fps, radius, shard_rows).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(lean(batches), "u long, v long")


def wide_majority(hashes: np.ndarray, lanes: int) -> bytes:
    """A fingerprint of ``64 * lanes`` bits: each lane mixes the hashes anew.

    Where exactly half of the hashes have a bit the first one decides, so that a
    bit is set with an even chance in texts of any length.
    """
    if not len(hashes):
        return bytes(8 * lanes)
    odd = np.uint64(0x9E3779B97F4A7C15)
    found = []
    for lane in range(lanes):
        mixed = (hashes ^ np.uint64(lane * 0xD6E8FEB86659FD93 % (1 << 64))) * odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= odd
        mixed ^= mixed >> np.uint64(29)
        twice = 2 * bit_counts(mixed)
        found.append(np.packbits((twice > len(mixed)) | (twice == len(mixed)) & (bit_counts(mixed[:1]) > 0)).tobytes())
    return b"".join(found)


#: Least shingles of a shard's key, and keys of a document: of two texts at a Jaccard similarity of 0.8 1 - (1 - 0.8**3)**6 = 0.987 meet.
LEAST, KEYS = 3, 6
ORDERS = np.random.default_rng(11).integers(0, 1 << 64, LEAST * KEYS, dtype=np.uint64) | np.uint64(1)


def least_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each of ``KEYS`` shards: which shingles ``LEAST`` random orders put first."""
    least = np.concatenate([(hashes[None, :] * ORDERS[k : k + LEAST, None]).min(axis=1) for k in range(0, len(ORDERS), LEAST)])
    key = np.arange(1, KEYS + 1, dtype=np.uint64)
    for k in range(LEAST):
        key = (key ^ least[k::LEAST]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def wide_fingerprints(docs: DataFrame, doc_id: str, text: str, words: int, lanes: int) -> DataFrame:
    """(doc_id, text_key, fp, n_shingles, keys): the wide fingerprint of the distinct shingles as binary, and its shards."""

    def batches(it):
        for b in slices(it):
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column(2).to_pylist()]
            keys = [least_keys(s) if len(s) else np.empty(0, np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([wide_majority(s, lanes) for s in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int32()), lists], ["doc_id", "text_key", "fp", "n_shingles", "keys"]
            )

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(batches), f"doc_id {kind}, text_key long, fp binary, n_shingles int, keys array<long>")


def set_chance(shared: int, own: int, hits: int) -> float:
    """Chance of a bit that ``hits`` of the shared hashes have, over all values of the set's own hashes."""
    return sum(math.comb(own, k) * (1.0 if 2 * (hits + k) > shared + own else 0.5 if 2 * (hits + k) == shared + own else 0.0) for k in range(own + 1)) / 2**own


def bit_difference(shared: int, a: int, b: int) -> float:
    """Chance that one bit differs between two sets with ``shared`` shingles and ``a`` and ``b`` of their own."""
    total = 0.0
    for hits in range(shared + 1):
        p, q = set_chance(shared, a, hits), set_chance(shared, b, hits)
        total += math.comb(shared, hits) / 2**shared * (p * (1 - q) + q * (1 - p))
    return total


@functools.cache
def most_difference(similarity: float, least: int) -> float:
    """The greatest :func:`bit_difference` of sets at the similarity of which one has ``least`` to 48 shingles.

    Larger sets approach the angle between them, acos(2 s / (1 + s)) / pi, from above.
    """
    found = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for n in range(least, 49):
        for m in range(n, math.floor(n / similarity + 1e-9) + 1):
            shared = math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
            if shared < n or shared == n < m:
                found = max(found, bit_difference(shared, n - shared, m - shared))
    return found


def finer_keys(rows: DataFrame, count: int, similarity: float, lanes: int, recall: float) -> DataFrame:
    """(key, fp): rows (shard, fp) of large shards in finer ones, one for each sample of bits.

    A key takes so many bits that of ``count`` strangers about sixteen share it,
    and there are as many keys as the recall asks for at the similarity.
    """
    width, bits = BITS * lanes, min(48, max(6, math.ceil(math.log2(max(2, count))) - 4))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - most_difference(similarity, 1)) ** bits))
    rng = np.random.default_rng(0)
    places = [rng.choice(width, bits, replace=False) for _ in range(tables)]
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)

    def batches(it):
        for b in it:
            fp = b.column(1).to_pylist()
            if not fp:
                continue
            on = np.unpackbits(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1), axis=1)
            keys = np.stack([(on[:, at].astype(np.uint64) * powers).sum(axis=1) for at in places], axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["shard", "fp", "keys"])

    wide = rows.select("shard", "fp").mapInArrow(lean(batches), "shard long, fp binary, keys array<long>")
    return wide.select("shard", "fp", F.posexplode("keys").alias("table", "bits")).select(F.xxhash64("shard", "table", "bits").alias("key"), "fp")


def value_of(fp: bytes) -> int:
    return int.from_bytes(fp, "big")


def sorted_groups(it, keys: int):
    """Rows of sorted batches, one iterator for each run of equal first ``keys`` columns: (key, rows)."""
    rows = (row for b in it for row in zip(*(c.to_pylist() for c in b.columns)))
    return itertools.groupby(rows, key=lambda row: row[:keys])


def pair_batches(pairs):
    """Record batches (u, v) of at most 10,000 pairs of bytes."""
    while taken := list(itertools.islice(pairs, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*taken)], ["u", "v"])


def oversized(keyed: DataFrame, shard_rows: int) -> DataFrame:
    """(hot_key, n) of the shards above ``shard_rows``, written first: a join that reuses the grouping's shuffle couldn't split a hot key."""
    return materialise(keyed.groupBy(F.col("key").alias("hot_key")).agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows), "simhash-hot")


def tree_edges(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that join all fingerprints within the radius inside a shard, which is a BK-tree."""

    def batches(it):
        def close(values, us, vs):
            if len(values) > 1:
                for u, v in shard_edges([value_of(x) for x in values], radius):
                    us.append(u.to_bytes(width, "big"))
                    vs.append(v.to_bytes(width, "big"))

        key, values, width = None, [], 0
        for b in it:
            keys, fps, us, vs = b.column(0).to_numpy(), b.column(1).to_pylist(), [], []
            width = len(fps[0]) if fps else width
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
            for a, z in zip(starts, [*starts[1:], len(keys)]):
                if key is None or keys[a] != key:
                    close(values, us, vs)
                    key, values = keys[a], []
                values += fps[a:z]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])
        us, vs = [], []
        close(values, us, vs)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(batches), "u binary, v binary")


def cluster_edges(distinct: DataFrame, radius: int, shard_rows: int, similarity: float, lanes: int, recall: float) -> DataFrame:
    """Edges (u, v) that join all fingerprints within the radius that meet in a shard.

    A shard above ``shard_rows`` (texts that share a common passage, or a large
    group of near copies) is dealt again by sampled bits.  What is still above
    it then agrees in most bits and is joined whole, by its least value: clusters
    may hold too much, but never too little.
    """
    keyed = distinct.select(F.explode("first.keys").alias("key"), "fp")
    hot = oversized(keyed, shard_rows)
    if hot.isEmpty():
        return tree_edges(keyed, radius).filter("u <> v").distinct()
    on = F.col("key") == F.col("hot_key")
    found = tree_edges(keyed.join(small(hot), on, "left_anti"), radius)
    again = keyed.join(small(hot), on).select(F.col("key").alias("shard"), "fp")
    finer = materialise(finer_keys(again, hot.agg(F.max("n")).first()[0], similarity, lanes, recall), "simhash-finer")
    whole = oversized(finer, shard_rows)
    found = found.unionByName(tree_edges(finer.join(small(whole), on, "left_anti"), radius))
    left = materialise(finer.join(small(whole), on).select("key", "fp"), "simhash-whole")
    pivots = materialise(left.groupBy(F.col("key").alias("of")).agg(F.min("fp").alias("pivot")), "simhash-pivots")
    joined = left.join(small(pivots), F.col("key") == F.col("of")).select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    return found.unionByName(joined).filter("u <> v").distinct()


def shingle_sets(distinct: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(fp, shingles): the sorted shingle hashes of the first document of each fingerprint, as bytes."""
    asked = small(distinct.select("fp", F.col("first.doc_id").alias("asked_id"), F.col("first.text_key").alias("asked_key")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = rows.join(asked, (F.col("text_key") == F.col("asked_key")) & F.col("doc_id").eqNullSafe(F.col("asked_id"))).select("fp", "text").dropDuplicates(["fp"])

    def batches(it):
        for b in slices(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["fp", "shingles"])

    return texts.mapInArrow(lean(batches), "fp binary, shingles binary")


class Verifier:
    """Distinct texts in a BK-tree; links those within the radius whose shingle sets are similar.

    Many candidates of a text are counted at once, on a table of shingle hashes
    modulo its size: no count is too low, so those that stay below the
    similarity there need no exact comparison.
    """

    TABLE, MANY = 1 << 20, 8

    def __init__(self, radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        self.tree, self.fps, self.sets, self.root = Tree(), [], [], []
        self.starts, self.size, self.cells = [], 0, np.empty(1 << 10, np.uint32)
        self.marks = None

    def top(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def add(self, fp: bytes, shingles: bytes) -> None:
        own = np.frombuffer(shingles, np.uint64)
        self.tree.add(value_of(fp))
        self.fps.append(fp)
        self.sets.append(own)
        self.root.append(len(self.root))
        self.starts.append(self.size)
        end = self.size + len(own) + 1
        if end > len(self.cells):
            self.cells = np.r_[self.cells, np.empty(max(end, len(self.cells)), np.uint32)]
        self.cells[self.size : end - 1] = own % np.uint64(self.TABLE)
        self.cells[end - 1] = self.TABLE  # never marked; no run of cells is empty
        self.size = end

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.root[max(a, b)] = min(a, b)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            return not len(b)
        if len(a) < self.similarity * len(b):
            return False
        shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return shared / (len(a) + len(b) - shared) >= self.similarity

    def promising(self, own: np.ndarray, hits: list[int]) -> list[int]:
        """The hits that share enough cells of the table."""
        if self.marks is None:
            self.marks = np.zeros(self.TABLE + 1, np.uint8)
        cells = own % np.uint64(self.TABLE)
        self.marks[cells] = 1
        shared = np.add.reduceat(self.marks[self.cells[: self.size]], self.starts, dtype=np.int64)
        self.marks[cells] = 0
        hits = np.array(hits)
        sizes = np.diff(np.r_[self.starts, self.size])[hits] - 1
        return hits[shared[hits] >= self.similarity / (1 + self.similarity) * (sizes + len(own)) - 1e-6].tolist()

    def links(self, fp: bytes, shingles: bytes, skip=()) -> list[int]:
        """One similar text of each group; near ones are tried first, groups in ``skip`` are not."""
        value, own, skip, found = value_of(fp), np.frombuffer(shingles, np.uint64), set(skip), []
        values = self.tree.values
        hits = self.tree.near(value, self.radius)
        if len(hits) > 1:
            hits.sort(key=lambda h: (values[h] ^ value).bit_count())
        for part in (hits[: self.MANY], hits[self.MANY :]):
            part = [h for h in part if self.top(h) not in skip]
            for h in self.promising(own, part) if len(part) > self.MANY else part:
                if self.top(h) not in skip and self.similar(own, self.sets[h]):
                    found.append(h)
                    skip.add(self.top(h))
        return found


def block_links(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (u, v) inside the blocks of clusters, one for each text and group that it joins."""

    def pairs(it):
        for _, group in sorted_groups(it, 2):
            block = Verifier(radius, similarity)
            for _, _, fp, shingles in group:
                hits = block.links(fp, shingles)
                block.add(fp, shingles)
                for h in hits:
                    block.join(h, len(block.fps) - 1)
                    yield fp, block.fps[h]

    # A text of a large cluster can be its pivot and in a block of its own; it then meets itself, which does no harm.
    return rows.select("cluster", "block", "fp", "shingles").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "fp").mapInArrow(lean(lambda it: pair_batches(pairs(it))), "u binary, v binary")


def cross_links(rows: DataFrame, roots: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (u, v) of texts of one cluster whose groups differ so far.

    Of each cluster the texts outside its largest group make trees; each tree
    goes to every block of the cluster, whose texts follow its edges.
    """
    rows = rows.join(roots, F.col("fp") == F.col("node"), "left").select("cluster", "n_blocks", "fp", "shingles", F.coalesce("root", "fp").alias("root"))
    rows = materialise(rows, "simhash-open")
    parts = rows.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    sizes = parts.groupBy(F.col("cluster").alias("of")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "root")).alias("top")).filter("n > top.n")
    share = F.greatest((F.col("n") - F.col("top.n")) / F.col("n"), (F.col("bytes") - F.col("top.bytes")) / F.greatest("bytes", F.lit(1)))
    sizes = materialise(sizes.select("of", F.col("top.root").alias("largest"), share.alias("share")), "simhash-sizes")
    met = rows.join(sizes, F.col("cluster") == F.col("of")).withColumn("n_trees", F.ceil(F.col("n_blocks") * F.col("share")).cast("int"))
    one_of = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    trees = met.filter("root <> largest").select("cluster", one_of("n_trees").alias("tree"), every("n_blocks").alias("block"), F.lit(0).alias("asks"), "fp", "root", "shingles")
    asking = met.select("cluster", every("n_trees").alias("tree"), one_of("n_blocks").alias("block"), F.lit(1).alias("asks"), "fp", "root", "shingles")

    def pairs(it):
        for _, group in sorted_groups(it, 3):
            cell, numbers = Verifier(radius, similarity), {}
            for _, _, _, asks, fp, root, shingles in group:
                if not asks:
                    cell.add(fp, shingles)
                    cell.root[-1] = numbers.setdefault(root, len(cell.root) - 1)
                else:
                    yield from ((fp, cell.fps[h]) for h in cell.links(fp, shingles, [numbers[root]] if root in numbers else []))

    both = trees.unionByName(asking).repartition("cluster", "tree", "block").sortWithinPartitions("cluster", "tree", "block", "asks")
    return both.mapInArrow(lean(lambda it: pair_batches(pairs(it))), "u binary, v binary")


def similar_links(
    distinct: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, similarity: float, lanes: int, recall: float = 0.98, shard_rows: int = 4096, block_shingles: int = 1 << 22
) -> DataFrame:
    """Edges (u, v) between wide fingerprints of texts of at least this similarity.

    Texts are dealt to shards by their least shingles; fingerprints in a shard
    within three deviations beyond the mean distance at the threshold are chained
    to clusters.  Inside a cluster the
    shingle sets decide: a text is compared with those within the radius, near
    ones first, until it has a link to each group that it meets.  A cluster
    above ``shard_rows`` texts or ``block_shingles`` shingles is dealt in blocks
    that hold eight of its texts in common; a second pass compares what is
    outside the largest group with all of the cluster, block by block.  So a
    large group of near copies costs a few comparisons a member, no task holds
    more than a block, and no link that would join two groups is left out.
    """
    width, differs = BITS * lanes, most_difference(similarity, 1)
    radius = math.ceil(width * differs + 3.0 * math.sqrt(width * differs * (1 - differs)))
    edges = materialise(cluster_edges(distinct, radius, shard_rows, similarity, lanes, recall), "simhash-edges")
    clusters = components(edges)
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    met = materialise(distinct.join(clusters, F.col("fp") == F.col("node")).select("fp", "first", "n_shingles", F.col("root").alias("cluster")), "simhash-clusters")
    pivots = F.array_compact(F.array(*[F.min(F.when(F.pmod(F.xxhash64("fp"), F.lit(8)) == k, F.col("fp"))) for k in range(8)]))
    sizes = met.groupBy(F.col("cluster").alias("of")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all"), pivots.alias("pivots"))
    blocks = F.ceil(F.greatest(F.col("n") / shard_rows, F.col("all") / block_shingles)).cast("int")
    sizes = materialise(sizes.select("of", F.greatest(blocks, F.lit(1)).alias("n_blocks"), "pivots"), "simhash-blocks")
    sets = shingle_sets(met, docs, doc_id, text, words).withColumnRenamed("fp", "own")
    placed = met.join(sizes, F.col("cluster") == F.col("of")).select("cluster", "fp", "n_blocks", F.expr("n_blocks > 1 and array_contains(pivots, fp)").alias("pivot"))
    rows = materialise(placed.join(sets, F.col("fp") == F.col("own")).drop("own"), "simhash-sets")
    everywhere = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    dealt = rows.withColumn("block", F.explode(F.when(F.col("pivot"), everywhere).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")))))
    links = materialise(block_links(dealt, radius, similarity), "simhash-links")
    release(edges, met, sizes)
    large = rows.filter("n_blocks > 1")
    if large.isEmpty():
        release(rows)
        return links
    return links.unionByName(cross_links(large, components(links), radius, similarity))


def simhash_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, similarity: float | None = None, lanes: int = 4, shard_rows: int = 4096
) -> DataFrame:
    """One row a document: doc_id, fp, component_id, group_size.

    Documents link within ``radius`` of 64 bits.  With ``similarity`` they link
    where the Jaccard similarity of their shingle sets is that or more; candidates
    come from fingerprints of ``64 * lanes`` bits.
    """
    if similarity is None:
        rows = materialise(fingerprints(docs, doc_id, text, words), "simhash-fingerprints")
        distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-distinct")
        roots = components(links(distinct, radius, shard_rows))
    else:
        rows = materialise(wide_fingerprints(docs, doc_id, text, words, lanes), "simhash-fingerprints")
        one = F.min(F.struct("doc_id", "text_key", "keys")).alias("first")
        distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), one, F.min("n_shingles").alias("n_shingles")), "simhash-distinct")
        roots = components(similar_links(distinct, docs, doc_id, text, words, similarity, lanes, shard_rows=shard_rows))
    placed = distinct.join(small(roots), F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "simhash-placed")
    # Written first: a join that reuses the grouping's shuffle couldn't split a group that a third of the rows are in.
    groups = materialise(placed.groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("component_id"), F.sum("n").alias("group_size")), "simhash-groups")
    labels = placed.join(groups, F.col("root") == F.col("of")).select(F.col("fp").alias("label_fp"), "component_id", "group_size")
    return rows.join(labels, F.col("fp") == F.col("label_fp")).select("doc_id", "fp", "component_id", "group_size")


def hex_fingerprint(fp: str = "fp"):
    """A 64-bit fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents without those near another: each group's smallest id stays.

    Rows that repeat the smallest id of their group are reduced to one.  Rows
    without an id stay, as no decision can name them.
    """
    found = simhash_groups(docs, doc_id, text, words, similarity=similarity).filter("doc_id is not null")
    ids = materialise(found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")), "simhash-ids")
    # Those that go are few beside those that stay, and so are the repeated ones.
    gone, twice = (small(materialise(ids.filter(f).select(F.col("doc_id").alias(name)), f"simhash-{name}")) for f, name in (("not stays", "gone"), ("stays and n > 1", "twice")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("own_id"))
    left = rows.join(gone, F.col("own_id") == F.col("gone"), "left_anti")
    if twice.isEmpty():
        return left.select("row.*")
    one = left.join(twice, F.col("own_id") == F.col("twice"), "left_semi").dropDuplicates(["own_id"])
    return left.join(twice, F.col("own_id") == F.col("twice"), "left_anti").unionByName(one).select("row.*")
