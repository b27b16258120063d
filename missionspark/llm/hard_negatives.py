"""Hard-negative mining by shared lists of anchor clusters.

Anchors are clustered by direction.  For a cluster with centre ``c`` and widest
angle ``w`` between ``c`` and a member, no member's inner product with a
candidate ``x`` exceeds ``|member| * |x| * cos(max(0, angle(x, c) - w))``.  A task
that holds a block of candidates sorts them by that bound once for each cluster,
and the members walk the list together, each until the bound of what follows
lies below what it still needs: then nothing further can enter its result.
Scores are exact integers, and the bound is widened by more than the rounding of
the angles, so ending early never changes a result.

The anchors are a stated query set and go against all rows in blocks.  A group
of anchors whose bytes are bounded is broadcast; every task streams its
candidates in blocks of ``BLOCK`` rows and returns what is best of all of them.
A sixteenth of the rows is searched first; what it gives is what the walks over
all rows need at least, so few rows leave a task, whatever the number of tasks.

Of candidates with equal label and vector only the first few identifiers can
enter any result (their scores are equal, and ties go by identifier), so the
others leave before the search, in the tasks that read them.

Positives come first, by one walk over rows of the anchor's label.  The scores
of an anchor's positives are windows for the negatives, ``low_percent`` of the
score to the score itself, and a second walk fills all windows of an anchor.

Defined cases: rows with a null label, identifier or vector, or with a null or
non-finite component, take no part; rows that repeat identifier, label and
vector count once; another row with the anchor's identifier is no positive of
it; vectors of different length are compared as if the shorter one went on with
zeros; components are taken as 64-bit integers and products beyond them wrap; an
anchor with fewer positives or negatives has those; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, new_path, release

#: Candidates that a task holds at once, and anchors' bytes that are broadcast at once.
BLOCK, GROUP_BYTES = 16_384, 8 << 20
#: Anchors that the cluster centres are fitted on, members that a cluster has about, clusters at most.
SAMPLE, MEMBERS, MOST_CLUSTERS = 20_000, 64, 256
#: Share of the rows that is searched first.
FIRST_SHARE = 16
EXACT = 2.0**53
NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, components as integers."""
    # The path of the columns is quoted, so that odd names do no harm.
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", odd))
        .select("vec_id", "label", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))
    )


def first_copies(rows: DataFrame, kept: int) -> DataFrame:
    """Of the rows with equal label and vector, those with the first ``kept`` identifiers."""
    same = Window.partitionBy("label", "v").orderBy("vec_id")
    return rows.withColumn("place", F.dense_rank().over(same)).filter(F.col("place") <= kept).drop("place").dropDuplicates(["label", "v", "vec_id"])


def matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Integer vectors as rows, cut or continued with zeros to one width."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.r_[0, np.cumsum(sizes)]
    for i, n in enumerate(np.minimum(sizes, width).tolist()):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and lengths."""
    v = v.astype(np.float64)
    top = np.maximum(np.abs(v).max(axis=1, initial=0.0), 1.0)
    length = np.linalg.norm(v / top[:, None], axis=1) * top
    return v / np.where(length > 0, length, 1.0)[:, None], length


def centres(units: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    found = units[rng.choice(len(units), k, replace=False)]
    for _ in range(rounds):
        near = (units @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, units)
        size = np.linalg.norm(sums, axis=1)
        found = np.where(size[:, None] > 1e-9, sums / np.where(size > 1e-9, size, 1.0)[:, None], found)
    return found


@dataclass
class Anchors:
    """A group of anchors: what every task of its search gets."""

    key: np.ndarray
    ident: np.ndarray
    label: np.ndarray
    v: np.ndarray
    cluster: np.ndarray
    centre: np.ndarray
    kept: int
    same_label: bool
    #: By anchor and window: scores that fit, and the score that a new row has to reach.
    low: np.ndarray
    high: np.ndarray
    need: np.ndarray

    def __post_init__(self):
        units, self.length = directions(self.v)
        self.width = []  # (members, cosine and sine of the widest angle)
        for c in range(len(self.centre)):
            members = np.flatnonzero(self.cluster == c)
            cosine = float(np.clip((units[members] @ self.centre[c]).min(), -1, 1)) if len(members) else 1.0
            self.width.append((members, float(np.arccos(cosine))))


def scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products of the rows."""
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Walk:
    """What a task has found for a group of anchors so far."""

    def __init__(self, anchors: Anchors):
        self.anchors = anchors
        self.need = anchors.need.copy()  # (anchor, window)
        empty = np.empty(0, np.int64)
        self.slot, self.score, self.ident = empty, empty, empty

    def keep(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Takes rows in; of each window the best stay, and raise what it needs."""
        touched = np.isin(self.slot, slot)
        s, p, i = (np.r_[x[touched], y] for x, y in ((self.slot, slot), (self.score, score), (self.ident, ident)))
        order = np.lexsort((i, -p, s))
        s, p, i = s[order], p[order], i[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        place = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
        full = place == self.anchors.kept - 1
        flat = self.need.reshape(-1)
        flat[s[full]] = np.maximum(flat[s[full]], p[full])
        stay = place < self.anchors.kept
        self.slot, self.score, self.ident = (np.r_[x[~touched], y[stay]] for x, y in ((self.slot, s), (self.score, p), (self.ident, i)))

    def block(self, ident: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        """Walks the lists of all clusters over a block of candidates."""
        a = self.anchors
        units, length = directions(v)
        margin = 1e-6 * length + 1e-6
        for members, widest in a.width:
            if not len(members):
                continue
            centre = a.centre[a.cluster[members[0]]]
            angle = np.arccos(np.clip(units @ centre, -1, 1))
            bound = length * np.cos(np.maximum(0.0, angle - widest)) + margin
            order = np.argsort(-bound)
            at, step = 0, 128
            while at < len(order):
                # A window that nothing can enter any more needs more than any score.
                wanted = self.need[members].min(axis=1)
                reach = np.where(bound[order[at]] >= 0, a.length[members] * (1 + 1e-9), 0.0) * bound[order[at]]
                beyond = a.length[members] * length.max() >= EXACT  # where floats can't certify an end
                active = members[(wanted <= reach) | beyond]
                active = active[(self.need[active] != np.iinfo(np.int64).max).any(axis=1)]
                if not len(active):
                    break
                some = order[at : at + step]
                self.chunk(active, ident[some], label[some], v[some], float(a.length[active].max() * length[some].max()))
                at, step = at + step, min(2 * step, 2048)

    def chunk(self, active: np.ndarray, ident: np.ndarray, label: np.ndarray, v: np.ndarray, most: float) -> None:
        a = self.anchors
        product = scores(a.v[active], v, most)
        same = a.label[active][:, None] == label[None, :]
        fits = same & (a.ident[active][:, None] != ident[None, :]) if a.same_label else ~same
        slots, found, idents = [], [], []
        for w in range(self.need.shape[1]):
            r, c = np.nonzero(fits & (product >= self.need[active, w][:, None]) & (product >= a.low[active, w][:, None]) & (product <= a.high[active, w][:, None]))
            slots.append(active[r] * self.need.shape[1] + w)
            found.append(product[r, c])
            idents.append(ident[c])
        slot = np.concatenate(slots)
        if len(slot):
            self.keep(slot, np.concatenate(found), np.concatenate(idents))


def walk(candidates: DataFrame, anchors: Anchors) -> DataFrame:
    """(key, window, score, vec_id, rank): the best candidates of all rows in each window of each anchor."""
    shared = candidates.sparkSession.sparkContext.broadcast(anchors)  # GROUP_BYTES bounds it

    def tasks(batches):
        found, held, rows = Walk(shared.value), [], 0

        def settle():
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                vectors = table.column("v").combine_chunks()
                found.block(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(vectors, shared.value.v.shape[1]))
                held.clear()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                settle()
                rows = 0
        settle()
        windows = found.need.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shared.value.key[found.slot // windows]), pa.array((found.slot % windows).astype(np.int32)), pa.array(found.score), pa.array(found.ident)],
            ["key", "window", "score", "vec_id"],
        )

    best = candidates.mapInArrow(tasks, "key long, window int, score long, vec_id long")
    ranked = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("*", ranked).filter(F.col("rank") <= anchors.kept)


def search(candidates: DataFrame, anchors: Anchors) -> list:
    """Rows of :func:`walk` over all candidates, a share of them first."""
    part = candidates.filter(F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(FIRST_SHARE)) == 0)
    place = {k: i for i, k in enumerate(anchors.key.tolist())}
    for r in walk(part, anchors).filter(F.col("rank") == anchors.kept).toLocalIterator():
        at = place[r.key], r.window
        anchors.need[at] = max(anchors.need[at], r.score)
    return walk(candidates, anchors)


def clustered(anchors: DataFrame, dims: int) -> tuple[DataFrame, np.ndarray]:
    """The anchors with their cluster, and the clusters' centres."""
    sample = anchors.orderBy(F.xxhash64(F.lit(5), "vec_id", "label", "v")).limit(SAMPLE).select("v").toArrow()
    units, _ = directions(matrix(sample.column("v").combine_chunks(), dims))
    k = max(1, min(MOST_CLUSTERS, len(units) // MEMBERS))
    found = centres(units, k)
    shared = anchors.sparkSession.sparkContext.broadcast(found)

    def assign(batches):
        for b in batches:
            units, _ = directions(matrix(b.column("v"), dims))
            yield b.append_column("cluster", pa.array((units @ shared.value.T).argmax(axis=1).astype(np.int32)))

    names = ", ".join(f"{n} {t}" for n, t in anchors.dtypes)
    return materialise(anchors.mapInArrow(assign, f"{names}, cluster int"), "negatives-anchors"), found


def grouped(anchors: DataFrame, rows_a_group: int) -> tuple[DataFrame, int]:
    """The anchors with a group, clusters kept together where they fit, and the number of groups."""
    groups, filled, first, parts = 0, 0, {}, {}
    for r in sorted(anchors.groupBy("cluster").count().collect()):
        if filled + r["count"] > rows_a_group and filled:
            groups, filled = groups + 1, 0
        first[r.cluster], parts[r.cluster] = groups, -(-r["count"] // rows_a_group)
        groups, filled = groups + parts[r.cluster] - 1, filled + r["count"] if parts[r.cluster] == 1 else rows_a_group
    pick = lambda numbers: F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), F.col("cluster"))
    return anchors.withColumn("group", pick(first) + F.pmod(F.xxhash64("key"), pick(parts)).cast("int")), groups + 1


def hard_negatives(
    rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", is_anchor: Column | None = None,
    positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``; by default identifiers divisible by 100.
    Negatives of a positive lie between ``low_percent`` hundredths of its score and its score.
    """
    spark = rows.sparkSession
    took_part = usable(rows, vec_id, vector, label, scale)
    chosen = (F.pmod("vec_id", F.lit(100)) == 0) if is_anchor is None else is_anchor
    anchors = materialise(took_part.filter(chosen).dropDuplicates(["vec_id", "label", "v"]).withColumn("key", F.monotonically_increasing_id()), "negatives-keyed")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dims = anchors.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], schema)
    candidates = materialise(first_copies(took_part, max(positives + 1, negatives)), "negatives-candidates")
    placed, found = clustered(anchors, dims)
    placed, groups = grouped(placed, max(1, group_bytes // (8 * max(1, dims))))
    path = new_path(spark, "negatives")
    for g in range(groups):
        table = placed.filter(F.col("group") == g).select("key", "vec_id", "label", "v", "cluster").toArrow().combine_chunks()
        n = table.num_rows
        bounds = lambda width: (np.full((n, width), NONE), np.full((n, width), np.iinfo(np.int64).max), np.full((n, width), NONE))
        columns = [table.column(c).to_numpy() for c in ("key", "vec_id", "label")]
        v = matrix(table.column("v").combine_chunks(), dims) if n else np.zeros((0, dims), np.int64)
        common = *columns, v, table.column("cluster").to_numpy(), found
        near = search(candidates, Anchors(*common, positives, True, *bounds(1))).select("key", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        near = materialise(near, "negatives-positives")
        low, high, need = bounds(positives)
        high[:] = NONE  # an anchor without so many positives has no window for them
        place = {k: i for i, k in enumerate(columns[0].tolist())}
        for r in near.select("key", "nth", "positive_score").toLocalIterator():  # a group's rows are bounded
            at = place[r.key], r.nth - 1
            low[at], high[at] = -((-low_percent * r.positive_score) // 100), r.positive_score
        need = np.where(low > high, np.iinfo(np.int64).max, low)
        need[high == NONE] = np.iinfo(np.int64).max
        far = search(candidates, Anchors(*common, negatives, False, low, high, need)).withColumnRenamed("key", "of")
        ids = placed.filter(F.col("group") == g).select(F.col("key").alias("at"), F.col("vec_id").alias("anchor_id"))
        whole = far.join(near, (F.col("of") == F.col("key")) & (F.col("window") == F.col("nth") - 1)).join(ids, F.col("of") == F.col("at"))
        whole.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        release(near)
    release(candidates)
    return spark.read.schema(schema).parquet(path)
