"""Sharding, hard negatives and token alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from missionspark.llm import hard_negatives, sharding, token_alignment

# -- sharding ------------------------------------------------------------------

ODD = [(1, None), (2, ""), (3, "same"), (4, "same"), (4, "same"), (4, "same"), (None, "é 日本"), (7, "x" * 100_000)] + [(100, "again")] * 40


def shard_docs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for name in ("slot", "shard", "doc", "at", "bucket", "size"):
        docs = docs.withColumn(name, F.lit(f"{name}!"))
    return docs


def test_shards_of_odd_rows(spark):
    for shards in (1, 8, 61):
        out = sharding.shard_report(shard_docs(spark, ODD), shards).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
        counts = Counter(r.shard for r in out)
        sizes = [counts.get(k, 0) for k in range(shards)]
        assert set(counts) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
        for k, n in counts.items():
            assert sorted(r.slot for r in out if r.shard == k) == list(range(n))
        assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    assert sharding.shard_report(shard_docs(spark, ODD).filter("false")).count() == 0


def test_shuffle_is_seeded_uniform_and_the_same_on_every_run(spark):
    n = 4_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    from missionspark.llm.storage import materialise

    docs = materialise(docs.repartition(3), "shard-test")
    order = lambda **o: {r.doc_id: (r.shard, r.slot) for r in sharding.shard_report(docs, **o).collect()}
    first = order()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert order() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert order(seed=30) != first
    place = np.array([500 * s + t for _, (s, t) in sorted(first.items())])
    assert sorted(place.tolist()) == list(range(n))
    assert abs(np.corrcoef(np.arange(n), place)[0, 1]) < 4 / math.sqrt(n)
    # An even share of each eighth of the input lies in each shard.
    table = np.histogram2d(np.arange(n) // 500, place // 500, bins=(8, 8))[0]
    assert ((table - 62.5) ** 2 / 62.5).sum() < 100  # 49 degrees of freedom
    assert abs((np.abs(np.diff(place)) == 1).sum() - 2) < 12  # neighbours part


def test_fisher_yates_inside_a_bucket_gives_all_orders(spark):
    rows = spark.range(600).select((F.col("id") / 3).cast("int").alias("bucket"), (F.col("id") % 3).alias("doc_id"), F.lit(0).alias("text_crc32"), F.lit(0).alias("size"), F.lit(0).alias("at"))
    mixed = sharding.shuffle_buckets(rows.repartitionById(200, "bucket"), 5).orderBy("bucket", "place").collect()
    orders = Counter(tuple(r.record.doc_id for r in mixed[3 * k : 3 * k + 3]) for k in range(200))
    assert len(orders) == 6 and max(orders.values()) < 70


def test_shards_written_hold_whole_rows(spark, tmp_path):
    docs = shard_docs(spark, ODD)
    sharding.write_shards(docs, str(tmp_path / "out"), 4, bucket_bytes=2_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select("doc.*").collect())) == Counter(map(tuple, docs.collect()))
    sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


# -- hard negatives --------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score double, key string"


def brute_negatives(rows, every, k=5):
    used = set()
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, label, v in used:
        if i % every:
            continue
        scored = [(-dot(v, w), j, other) for j, other, w in used]
        best = sorted((s, j) for s, j, other in scored if other == label and j != i)[:k]
        for s, p in best:
            far = sorted((t, j) for t, j, other in scored if other != label and -80 * s <= -100 * t <= -100 * s)[:k]
            out.update((i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(far, 1))
    return out


def mined(spark, rows, every, **options):
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), is_anchor=F.col("vec_id") % every == 0, **options)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def test_hard_negatives_as_by_all_pairs(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 12))
    rows = []
    for i in range(900):
        v = middle[rng.integers(6)] + 0.3 * rng.normal(size=12)
        v = v * rng.choice([0.05, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(4)), 0.0, "x"))
    want = brute_negatives(rows, 3)
    assert len(want) > 3_000
    assert mined(spark, rows, 3) == want
    assert mined(spark, rows, 3, group_bytes=12 * 8 * 40) == want  # eight groups of anchors


def test_hard_negatives_of_odd_rows(spark):
    same = [(1_000 + i, [1.0, 0.5], i % 2, 0.0, "x") for i in range(40)]  # a common vector, ties by identifier
    rows = same + [same[0], (1_000, [0.9, 0.5], 1, 0.0, "x"), (1_000, [0.9, 0.6], 0, 0.0, "x"), (None, [1.0, 1.0], 1, 0.0, "x"), (5, None, 1, 0.0, "x"), (6, [1.0, None], 1, 0.0, "x"), (7, [float("nan"), 1.0], 1, 0.0, "x"), (8, [float("inf"), 1.0], 0, 0.0, "x"), (9, [1.0, 1.0], None, 0.0, "x")]
    rows += [(10, [], 0, 0.0, "x"), (20, [0.0, 0.0], 1, 0.0, "x"), (30, [1.0, 0.4, 7.0], 0, 0.0, "x"), (40, [-1.0, -0.5], 1, 0.0, "x"), (50, [-1.0, -0.4], 0, 0.0, "x"), (60, [-1.0, -0.4], 1, 0.0, "x")]
    rows += [(2_000, [3.0e6, 2.0e6], 0, 0.0, "x"), (2_010, [3.1e6, 2.0e6], 0, 0.0, "x"), (2_020, [2.9e6, 2.1e6], 1, 0.0, "x")]  # products beyond what doubles hold
    assert mined(spark, rows, 10) == brute_negatives(rows, 10)
    assert mined(spark, rows[:0], 10) == Counter()
    assert mined(spark, [r for r in rows if r[0] in (5, 6, 7)], 10) == Counter()


def test_bound_is_never_below_a_score():
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (400, 6))
    units, length = hard_negatives.directions(v)
    found = hard_negatives.centres(units[:60], 5)
    a = hard_negatives.Anchors(np.arange(60), np.arange(60), np.zeros(60), v[:60], (units[:60] @ found.T).argmax(axis=1), found, 5, True, *(np.zeros((60, 1), np.int64),) * 3)
    for members, widest in a.width:
        if len(members):
            angle = np.arccos(np.clip(units @ found[a.cluster[members[0]]], -1, 1))
            bound = length * np.cos(np.maximum(0.0, angle - widest)) + 1e-6 * length + 1e-6
            assert (v[members] @ v.T <= np.outer(a.length[members] * (1 + 1e-9), bound)).all()


# -- alignment -------------------------------------------------------------------

TEXTS = [
    None, "", "plain words here", "plain words here", " two  spaces\n\nand lines ", "trailing ", "\t\ttabs \t x", "it's 12345 don't!", "naïve café 日本語 🎉 ¿qué?", "marked ▁ text ▁▁", "▁", "a ▁b",
    "<|endoftext|> is text </s> <unk> <0x41>", "\x00 null \x1c sep", " ", "   ", " nbsp em", "ab" * 2_000, "word " * 3_000, "x " + " " * 500 + "y", "ſ K Å ﬁ",
]


@pytest.fixture(scope="module")
def both():
    contents = []
    for path in (token_alignment.BYTE_MODEL, token_alignment.PIECE_MODEL):
        try:
            with open(path, "rb") as f:
                contents.append(f.read())
        except OSError:
            pytest.skip("no vocabulary files")
    return token_alignment.tokenizers_of(*contents)


def brute_alignment(texts):
    import sentencepiece
    import tokenizers

    left = tokenizers.Tokenizer.from_file(token_alignment.BYTE_MODEL)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_MODEL)
    alphabet = token_alignment.byte_alphabet()
    raw_a = lambda i: bytes(alphabet[c] for c in left.id_to_token(i))
    raw_b = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for t in texts:
        a = left.encode(" " + t, add_special_tokens=False).ids if t else []
        b = right.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if not t or b"".join(map(raw_a, a)) != want or b"".join(map(raw_b, b)) != want:
            a, b = [], []
        spans = []
        for ids, raw in ((a, raw_a), (b, raw_b)):
            at, here = 0, []
            for i in ids:
                here.append((at, at + len(raw(i))))
                at += len(raw(i))
            spans.append(here)
        links, near = [], 0
        for x, (lo, hi) in enumerate(spans[0]):
            while spans[1][near][1] <= lo:
                near += 1
            y = near
            while y < len(b) and spans[1][y][0] < hi:
                links.append((x, y, min(hi, spans[1][y][1]) - max(lo, spans[1][y][0])))
                y += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([i for i, (_, e) in zip(a, spans[0]) if lo < e <= hi], [i for i, (_, e) in zip(b, spans[1]) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)] if len(a) < 5_000 else None
        counts.update((a[x], b[y]) for x, y, _ in links)
        rows.append((a, b, links, cuts, groups))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for a, b, links, cuts, groups in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        pairs = [(a[x], b[y]) for x, y, _ in links]
        shared = sum(len(x) * len(y) for x, y in groups)
        out.append((len(a), len(b), len(cuts), len(links), sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else "", shared))
    return out, [r[2] for r in rows]


@pytest.mark.parametrize("broadcast_pairs", [1 << 19, 12, 0])
def test_alignment_as_by_hand(spark, both, broadcast_pairs):
    want, _ = brute_alignment(TEXTS)
    assert sum(w[0] > 0 for w in want) >= 14 and sum(w[0] == 0 for w in want) >= 5
    docs = spark.createDataFrame([(None if k == 2 else k // 2, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, row string, pairs int").repartition(2)
    out = token_alignment.alignment(docs, broadcast_pairs=broadcast_pairs).collect()
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_shared) for r in out)
    assert got == Counter((None if k == 2 else k // 2, *w) for k, w in enumerate(want))
    assert token_alignment.alignment(docs.filter("false")).count() == 0


def test_links_by_token(spark, both):
    _, links = brute_alignment(TEXTS)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = Counter((r.doc_id, r.a_token, r.b_token, r.value) for r in token_alignment.link_table(docs).collect())
    assert got == Counter((k, x, y, n) for k, here in enumerate(links) for x, y, n in here)
    some = docs.filter(F.col("doc_id").isin(2, 4, 8, 17))
    shared = token_alignment.link_table(some, shared_groups=True).groupBy("doc_id").count().collect()
    want = {r.doc_id: r.n_shared for r in token_alignment.token_pairs(some).collect()}
    assert {r.doc_id: r["count"] for r in shared} == want


@pytest.mark.parametrize("at_once", [1, 7, 10_000])
def test_gustavson_as_dense_product(at_once):
    rng = np.random.default_rng(2)
    a, b = (rng.random((9, 6)) < 0.4).astype(int), (rng.random((6, 11)) < 0.3).astype(int)
    rows = lambda m: token_alignment.Rows(np.r_[0, np.cumsum(m.sum(axis=1))], np.nonzero(m)[1], m.shape[1])
    got = np.zeros((9, 11), int)
    for i, j, value in rows(a).times(rows(b), at_once):
        got[i, j] += value
    assert (got == a @ b).all()
    t = rows(a).transposed()
    assert (t.starts == rows(a.T).starts).all() and (t.columns == rows(a.T).columns).all()


def test_memory_forgets_and_long_parts(both):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 70))) for _ in range(80)) for _ in range(6)]
    memory = token_alignment.Memory()
    whole = token_alignment.rows_of(texts, *both, memory)
    assert all(len(p) <= token_alignment.SHORT for p in memory.late)
    was, token_alignment.REMEMBERED = token_alignment.REMEMBERED, 10
    try:
        small = token_alignment.Memory()
        parts = [token_alignment.rows_of([t], *both, small)[0] for t in texts]
        assert len(small.late) <= 10
    finally:
        token_alignment.REMEMBERED = was
    for x, y in zip(whole, parts):
        assert x[:6] == y[:6] and (x[6] == y[6]).all() and (x[7] == y[7]).all()
