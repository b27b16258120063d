"""Toxic passages by maximum-scoring segments.

A word's score is its log-odds between toxic and other labelled documents under
an informative Dirichlet prior, kept where it is significant; a word that is
not known is scored by its longest known beginning, so that forms of a root
that never met a label count.  All other words cost a small drift.  One pass
over a document finds every maximal segment (Ruzzo and Tompa); under chance the
best score of n words follows an extreme-value law with the rate that solves
``sum(p * exp(rate * score)) = 1``, which turns a segment's score into a
chance.  A document's significant segments, as the sum of their scores beyond
chance, give its score by a logistic curve fitted on the labelled rows.

The labelled rows are a sample of at most ``max_labels`` (by digest of the id),
so the word table that goes to the tasks is bounded by ``max_terms``.

Defined cases: null or empty text has no segment and gets the score of a
document without evidence; a document with several labels counts as toxic if
one says so; null ids carry no label; copies of a labelled text count once; with
no labels of one kind the score is the share of toxic labels, 0.0 without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import lean, slices
from .storage import materialise

TOKEN = re.compile(r"[^\W_]+")
#: Lengths of beginnings that stand for words of one root.
STEMS = (4, 5, 6, 7)
SEGMENT = "array<struct<start:int,end:int,score:double,chance:double>>"


def units(token: str) -> list[str]:
    """A word and its beginnings, longest first; ``*`` marks a beginning."""
    return [token] + [f"{token[:k]}*" for k in reversed(STEMS) if len(token) >= k]


@dataclass
class Model:
    """Word scores, drift, the extreme-value law and the logistic curve."""

    terms: dict[str, float]
    drift: float = 0.05
    rate: float = 1.0
    space: float = 0.1
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])

    def __post_init__(self):
        # Every unit of a word begins like the word, so four letters rule most words out.
        self.starts = {u.rstrip("*")[:4] for u in self.terms}

    def word(self, token: str) -> float:
        return next((self.terms[u] for u in units(token) if u in self.terms), 0.0)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last word, score) of a document.

    ``hits`` are the positions with a positive score; each other word costs
    ``drift``.  Linear in the hits: the stack holds candidate segments with the
    running sums before and after them, and the latest candidate below that
    starts from a lower sum, so that none is looked at twice.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for place, score in hits:
        before = total - (place - at) * drift
        total, at = before + score, place + 1
        first, low, high = place, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, place, low, high, j))
    return [(a, z, high - low) for a, z, low, high, _ in stack]


def read(text: str | None, model: Model) -> tuple[int, list[tuple[int, float]]]:
    """Number of words, and the positions with a score."""
    tokens = TOKEN.findall(text.lower()) if text else []
    starts = model.starts
    near = [(i, t) for i, t in enumerate(tokens) if t[:4] in starts]
    return len(tokens), [(i, s) for i, t in near if (s := model.word(t)) > 0]


def passages(text: str | None, model: Model, level: float = 0.05) -> list[tuple[int, int, float, float]]:
    """Significant segments (start, end exclusive, score beyond chance, chance)."""
    n, hits = read(text, model)
    found = []
    for a, z, score in segments(hits, model.drift):
        beyond = model.rate * score - math.log(max(1e-12, model.space * n))
        chance = -math.expm1(-math.exp(min(50.0, -beyond)))
        if chance < level:
            found.append((a, z + 1, beyond, chance))
    return found


def evidence(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
    """What the curve sees: the summed and the best score beyond chance."""
    return math.log1p(sum(s for _, _, s, _ in found)), max((s for _, _, s, _ in found), default=0.0) / 10


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def solve_rate(drift: float, chances: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of the chance-weighted sum of exp(rate * score) = 1."""
    rest = max(0.0, 1 - chances.sum())

    def beyond(x: float) -> float:
        return rest * math.exp(-x * drift) + float((chances * np.exp(np.minimum(x * scores, 600))).sum()) - 1

    low, high = 0.0, 1e-6
    while beyond(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) < 0 else (low, mid)
    return high


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps, each halved until the loss falls.

    The ridge on the slopes keeps the curve finite where a feature separates the classes.
    """
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.array([1e-6, *[ridge] * (x.shape[1] - 1)])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            break
        w = w + size * step
    return w.tolist()


def logistic(curve: list[float], x: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, curve[0] + curve[1] * x[0] + curve[2] * x[1]))))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_labels: int) -> DataFrame:
    """(text, toxic) of the rows to learn from, copies of a text counted once."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("label_id")).agg(F.max(label).alias("toxic"))
        .orderBy(F.md5(F.col("label_id").cast("string")), "label_id").limit(max_labels)
    )
    # At most max_labels rows of two numbers: a bounded broadcast, and no text moves to find them.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    return rows.groupBy(F.md5(F.lower("text")).alias("copy")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("copy")


def term_scores(rows: DataFrame, prior: float, least_z: float, max_terms: int) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Significant positive log-odds of units, with their chance in other text."""

    def count(it):
        seen: Counter = Counter()
        toxic: Counter = Counter()
        for b in it:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {u for w in set(TOKEN.findall(t.lower())) for u in units(w)}
                (toxic if y else seen).update(own)
        names = list(seen.keys() | toxic.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[u] for u in names], pa.int64()), pa.array([seen[u] for u in names], pa.int64())], ["unit", "toxic", "other"])

    counts = rows.mapInArrow(lean(count), "unit string, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = materialise(counts, "toxicity-units")
    n_toxic, n_other = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("other")).first())
    if not n_toxic or not n_other:
        return {}, np.empty(0), np.empty(0)
    pseudo = (F.col("toxic") + F.col("other")) * prior
    size = prior * (n_toxic + n_other)
    odds = lambda y, n: F.log((y + pseudo) / (F.lit(n + size) - y - pseudo))
    scored = (
        counts.withColumn("score", odds(F.col("toxic"), n_toxic) - odds(F.col("other"), n_other))
        .withColumn("z", F.col("score") / F.sqrt(1 / (F.col("toxic") + pseudo) + 1 / (F.col("other") + pseudo)))
        .filter((F.col("score") > 0) & (F.col("z") >= least_z))
        .orderBy(F.desc("z"), "unit").limit(max_terms).collect()
    )
    return {r["unit"]: r["score"] for r in scored}, np.array([(r["other"] + 0.5) / n_other for r in scored]), np.array([r["score"] for r in scored])


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_labels: int = 20_000, max_terms: int = 20_000, prior: float = 0.1, least_z: float | None = None, drift: float = 0.05,
) -> Model:
    """Learns a model from the labelled rows that are not held out.

    With more labelled text more words are tried, and more seem toxic by chance;
    the significance asked for (``least_z``) grows with the logarithm of the
    number of toxic rows.
    """
    rows = materialise(labelled(docs, labels, doc_id, text, label, max_labels), "toxicity-labelled")
    if least_z is None:
        least_z = 1 + math.log(max(1, rows.filter("toxic > 0").count())) / 2
    terms, chances, scores = term_scores(rows, prior, least_z, max_terms)
    model = Model(terms, drift)
    share = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    if not terms:
        model.curve = [math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0]
        return model
    model.rate = solve_rate(drift, chances, scores)

    def measure(it):
        for b in it:
            found = []
            for t in b.column(0).to_pylist():
                n, hits = read(t, model)
                found.append((n, max((s for _, _, s in segments(hits, drift)), default=0.0)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["toxic", "n", "best"])

    # The mean of an extreme-value law is its place plus Euler's constant.
    chance = rows.mapInArrow(lean(measure), "toxic int, n long, best double").filter("toxic = 0 and best > 0 and n > 0")
    place = chance.agg(F.avg(F.lit(model.rate) * F.col("best") - F.log("n"))).first()[0]
    model.space = min(1.0, max(1e-3, math.exp(place - 0.5772156649))) if place is not None else 0.1

    def look(it):
        for b in it:
            x = [evidence(passages(t, model)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([a for a, _ in x], pa.float64()), pa.array([z for _, z in x], pa.float64())], ["toxic", "total", "best"])

    seen = rows.mapInArrow(lean(look), "toxic int, total double, best double").groupBy("toxic", F.round("total", 2).alias("total"), F.round("best", 2).alias("best")).count().toPandas()
    weight = np.repeat(np.arange(len(seen)), seen["count"].to_numpy())
    model.curve = fit_curve(seen[["total", "best"]].to_numpy(float)[weight], seen["toxic"].to_numpy(float)[weight])
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, segments in words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def batches(it):
        known = shared.value
        for b in slices(it):
            found = [passages(t, known) for t in b.column(1).to_pylist()]
            scores = [logistic(known.curve, evidence(f)) for f in found]
            spans = [[{"start": a, "end": z, "score": s, "chance": c} for a, z, s, c in f] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "segments"])

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(batches), f"doc_id {kind}, score double, segments {SEGMENT}")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "segments")


def clean_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that the model doesn't reject, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        known = shared.value
        for b in slices(it):
            keep = [logistic(known.curve, evidence(passages(t, known))) < threshold for t in b.column(text).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(batches), docs.schema)
