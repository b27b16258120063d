"""Exact and near deduplication, mixing, and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from missionspark.llm import exact_dedup, mixing, simhash, suffix_dedup
from missionspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "Same Text"), (4, "same text"), (5, "ÉA"), (6, "éa"), (7, "Éa"), (None, "same text"), (4, "same text"), (9, "x " * 30_000), (10, "X " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i and i % 3 == 0 else "s", 0) for i, t in rows], DOCS)


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup_odd_rows(spark, files):
    out = exact_dedup.exact_dedup(frame(spark, ODD).repartition(3), files_per_batch=files).collect()
    assert len(out) == len(ODD)
    by_text = {}
    for i, t in ODD:
        by_text.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
    for r in out:
        group = by_text[r.text_sha256]
        assert r.group_size == len(group) and r.keep_id == max(x for x in group if x is not None) and r.doc_id in group
    kept = [r for r in out if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(by_text) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_empty_and_pipeline_form(spark):
    assert exact_dedup.exact_dedup(frame(spark, []).filter("false")).count() == 0
    docs = frame(spark, ODD).withColumn("digest", F.lit("clash")).withColumn("locator", F.lit(1)).withColumn("doc", F.lit(2))
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect())) == [2, 4, 6, 7, 10]


def weak(content):
    """A digest of one hexadecimal digit, so that other bytes hit it."""
    return F.substring(F.sha2(content, 256), 1, 1)


def test_other_bytes_leave_the_group(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(300, None), (301, ""), (301, "")]
    out = exact_dedup.exact_dedup(frame(spark, rows).repartition(4), digest=weak).collect()
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    assert len(out) == len(rows) and len({r.text_sha256 for r in out}) <= 16
    for r in out:
        group = by_text[dict(rows)[r.doc_id] or ""]
        assert (r.keep_id, r.group_size) == (max(group), len(group))
    assert sorted(r.doc_id for r in out if r.kept) == sorted(max(g) for g in by_text.values())


def test_rows_that_share_a_place_in_a_file(spark, tmp_path):
    """Exploded and joined rows of one file row are rows of their own; filtered scans are read in place."""
    path = str(tmp_path / "docs")
    frame(spark, [(1, "a"), (2, "b")]).write.parquet(path)
    docs = spark.read.parquet(path)
    assert exact_dedup.scan_alone(docs.filter("doc_id > 0").select("doc_id", "text"))
    twice = docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    joined = docs.join(spark.createDataFrame([(1,), (1,), (2,)], "k long"), F.col("doc_id") == F.col("k"))
    for rows, n in ((twice, 4), (joined, 3)):
        assert not exact_dedup.scan_alone(rows)
        out = exact_dedup.exact_dedup(rows).collect()
        assert len(out) == n and sorted(r.doc_id for r in out if r.kept) == [1, 2] and exact_dedup.deduplicated(rows).count() == 2


def test_a_file_that_is_listed_twice(spark, tmp_path):
    """Its rows are there twice, and of each text one row stays."""
    path = str(tmp_path / "docs")
    frame(spark, [(1, "a"), (2, "b"), (3, "A")]).coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path, path)
    assert not exact_dedup.scan_alone(docs)
    out = exact_dedup.exact_dedup(docs).collect()
    assert len(out) == 6 and sorted(r.doc_id for r in out if r.kept) == [2, 3] and {r.doc_id: r.group_size for r in out} == {1: 4, 2: 2, 3: 4}


def test_state_outlives_the_call(spark, tmp_path):
    store = str(tmp_path / "store")
    first = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, [(1, "a"), (5, "b"), (2, "A")]), store=store).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in first.items()} == {1: (2, 2, False), 2: (2, 2, True), 5: (5, 1, True)}
    second = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, [(3, "B"), (4, "a"), (9, "c")]), store=store).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in second.items()} == {3: (5, 2, False), 4: (4, 3, True), 9: (9, 1, True)}
    third = exact_dedup.exact_dedup(frame(spark, [(7, "z"), (8, "A")]), store=store).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in third} == {7: (7, 1), 8: (8, 4)}
    assert exact_dedup.exact_dedup(frame(spark, []).filter("false"), store=store).count() == 0


def test_bytes_are_read_at_the_locator_of_an_earlier_call(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILES", 1)
    """Another text with the digest of a text kept by a call before leaves its group."""
    store, one = str(tmp_path / "store"), lambda content: F.lit("same")
    exact_dedup.exact_dedup(frame(spark, [(50, "kept")]), store=store, digest=one).collect()
    out = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, [(1, "KEPT"), (2, "other"), (3, "other")]), store=store, digest=one).collect()}
    assert {i: (r.keep_id, r.kept) for i, r in out.items()} == {1: (50, False), 2: (3, False), 3: (3, True)} and out[1].group_size == 2


def brute_fingerprint(text, k=3):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", lower(text))]
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, linked):
    root = {i: i for i in items}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in items}


def near_texts():
    base = words(1, 400).split()
    found = {1: None, 2: "", 3: "one two", 4: "ONE  two"}
    for k in range(40):
        own = list(base)
        for j in range(k // 4):
            own[(j * 37) % 400] = f"new{k}{j}"
        found[10 + k] = " ".join(own)
    return found | {100 + k: words(50 + k, 60) for k in range(20)}


def test_simhash_against_brute_force(spark):
    texts = near_texts()
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(sorted(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    out = simhash.simhash_groups(frame(spark, list(texts.items())).repartition(5)).withColumn("fingerprint", simhash.hex_fingerprint()).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in out} == fps and {r.doc_id: r.component_id for r in out} == want


def test_shards_too_large_are_cut_again(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(10) | rng.getrandbits(8) << 30 for _ in range(300)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute_components(sorted(values), lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.node: r.root for r in components(simhash.links(fps, 2, shard_rows=8)).collect()}
    assert {v: got.get(v, v) for v in values} == want


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(5)
    values = list({rng.getrandbits(64) & rng.getrandbits(64) for _ in range(300)} | {1, 3, 7, 15})
    tree = simhash.Tree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(tree.values[i] for i in tree.near(v, 9)) == sorted(x for x in values if (x ^ v).bit_count() <= 9)


def jaccard(a, b):
    s = [set(zip(*(t.split()[k:] for k in range(5)))) or {tuple(t.split())} for t in (a, b)]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def varied(base, seed, edits):
    rng, own = random.Random(seed), list(base)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
    return " ".join(own)


def similar_texts():
    """Pairs of all similarities and lengths, some just at 0.8."""
    texts = {}
    for g in range(60):
        base = words(g, 20 + 7 * g).split()
        texts[10 * g] = " ".join(base)
        for c in range(1, 6):
            texts[10 * g + c] = varied(base, 10 * g + c, c * len(base) // 110)
    for g in range(40):  # 8 against 9 words, 12 against 13 words: four of five and eight of nine shingles
        base = words(7000 + g, 13).split()
        texts |= {1000 + 10 * g: " ".join(base[:8]), 1001 + 10 * g: " ".join(base[:9]), 1005 + 10 * g: " ".join(base[:7])}
    return texts | {5000 + k: words(9000 + k, 5 + k) for k in range(60)} | {5100: None, 5101: "", 5102: "one two", 5103: "ONE two"}


def components_of(out):
    return {r.doc_id: r.component_id for r in out.collect()}


def test_links_at_a_similarity_against_brute_force(spark):
    texts = similar_texts()
    low = {i: lower(t) for i, t in texts.items()}
    got = components_of(simhash.simhash_groups(frame(spark, list(texts.items())).repartition(5), words=5, similarity=0.8))
    pairs = [(a, b) for a, b in __import__("itertools").combinations(sorted(texts), 2) if a // 10 == b // 10 and jaccard(low[a], low[b]) >= 0.8]
    want = brute_components(sorted(texts), lambda a, b: a // 10 == b // 10 and (a, b) in pairs or {a, b} in ({5100, 5101}, {5102, 5103}))
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 150 and found >= 0.97 * len(pairs)  # nothing but the shards' recall
    short = [(a, b) for a, b in pairs if len(low[b].split()) < 10]
    assert len(short) >= 40 and sum(got[a] == got[b] for a, b in short) >= 0.9 * len(short)
    assert all(want[i] == want[k] for i, k in got.items())  # no link below the similarity
    assert got[5100] == got[5101] and got[5102] == got[5103] == 5102


@pytest.mark.parametrize("shard_rows", [4096, 24])
def test_large_groups_of_near_copies(spark, shard_rows):
    """A group dealt in blocks has the components of all its pairs."""
    base, texts = words(1, 120).split(), {}
    for k in range(160):
        texts[k] = varied(base, k, 1 + k % 6)
    texts |= {1000 + k: words(3000 + k, 100) for k in range(30)}
    want = brute_components(sorted(texts), lambda a, b: b < 1000 and jaccard(texts[a], texts[b]) >= 0.8)
    got = components_of(simhash.simhash_groups(frame(spark, list(texts.items())), words=5, similarity=0.8, shard_rows=shard_rows))
    assert got == want and 1 < len({want[k] for k in range(160)}) < 120


def test_wide_bits_are_even_and_differ_as_told():
    rng = np.random.default_rng(1)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    bits = lambda f: np.unpackbits(np.frombuffer(f, np.uint8))
    for n in (1, 2, 4, 6, 9, 40):
        share = np.mean([bits(simhash.wide_majority(np.unique(draw(n)), 4)).mean() for _ in range(60)])
        assert abs(share - 0.5) < 0.03
    for shared, a, b in ((4, 0, 1), (8, 1, 1), (80, 10, 10)):
        apart = []
        for _ in range(80):
            s = draw(shared)
            x, y = (simhash.wide_majority(np.unique(np.r_[s, draw(k)]), 4) for k in (a, b))
            apart.append((bits(x) != bits(y)).mean())
        assert np.mean(apart) < simhash.bit_difference(shared, a, b) + 0.012 and simhash.bit_difference(shared, a, b) <= simhash.most_difference(0.8, 1) + 1e-9
    assert simhash.wide_majority(draw(0), 4) == bytes(32)


def test_candidates_counted_at_once_lose_none():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 64, 90, dtype=np.uint64))
    block = simhash.Verifier(256, 0.8)
    sets = [np.unique(np.r_[base[: 90 - k % 12], rng.integers(0, 1 << 64, k % 9, dtype=np.uint64)]) for k in range(60)]
    for s in sets:
        block.add(simhash.wide_majority(s, 4), s.tobytes())
    for s in sets[:20]:
        near = [h for h in range(60) if len(np.intersect1d(s, sets[h])) / len(np.union1d(s, sets[h])) >= 0.8]
        assert sorted(block.links(simhash.wide_majority(s, 4), s.tobytes())) == near  # each is a group of its own
        assert set(near) <= set(block.promising(s, list(range(60))))


def test_near_duplicates_odd_rows(spark):
    out = simhash.representatives(frame(spark, [(None, "a b c"), (None, None), (1, ""), (2, None), (3, "a b c d e f g"), (3, "a b c d e f g")]).withColumn("fp", F.lit(1)))
    assert sorted((r.doc_id is None, r.doc_id) for r in out.filter("doc_id is not null").collect()) == [(False, 1), (False, 3)] and out.filter("doc_id is null").count() == 2
    assert simhash.simhash_groups(frame(spark, []).filter("false")).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + k: 100 for k in range(1, 50)}}


def test_water_filling_by_rounds(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 3000, None: 10}
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1, 5, 2]))
    budget, free, target = 1.5 * sum(sizes.values()), set(sizes), dict.fromkeys(sizes, 0.0)
    while free:
        level = (budget - sum(2 * sizes[s] for s in sizes if s not in free)) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        target |= {s: level * weights[s] for s in free}
        if not over:
            break
        free -= over
        target |= {s: 2.0 * sizes[s] for s in over}
    df = spark.createDataFrame([(s, n, weights[s], i) for i, (s, n) in enumerate(sizes.items())], "source string, source_size long, weight int, rank int")
    assert {r.source: r.target for r in mixing.water_fill(df, 1.5, 2.0).collect()} == pytest.approx(target)


def test_mix_meets_targets_and_odd_rows(spark):
    rows = [(i, words(i, 1 + i % 9) if i % 11 else None, "en", ("x", "y", None)[i % 3] if i % 7 else "z", 0) for i in range(600)] + [(5, "a b", "en", "x", 0)] * 2 + [(None, "q r", "en", "y", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs.repartition(4)).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size and r.taken == r.size * r.repeats for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5 and sum(r.size for r in own) == own[0].source_size
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mixed = mixing.mixture(docs.withColumn("size", F.lit("clash")))
    assert mixed.count() == sum(r.repeats for r in out) and mixed.columns[-1] == "size"
    assert mixing.mix(docs.filter("false")).count() == 0


def test_mix_of_empty_texts(spark):
    assert {r.taken for r in mixing.mix(frame(spark, [(1, None), (2, ""), (3, " ")])).collect()} == {0}


def brute_marks(texts, n=50):
    """Words of each document inside a run of n words that another one holds."""
    where = {}
    split = {i: (t or "").split() for i, t in texts.items()}
    for i, w in split.items():
        for k in range(len(w) - n + 1):
            where.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {i: {j for k in range(len(w) - n + 1) if len(where[tuple(w[k : k + n])]) > 1 for j in range(k, k + n)} for i, w in split.items()}


def test_passages_against_brute_force(spark):
    p, q, short = words(1, 70), words(2, 51), words(3, 49)
    texts = {i: f"{words(100 + i, 80)} {p} {words(200 + i, 40)}" for i in range(12)}
    texts |= {20 + i: f"{q} {words(300 + i, i)} {short} {words(400 + i, 60)}" for i in range(8)}
    texts |= {30: words(9, 200), 31: words(9, 200), 32: words(9, 200) + " tail", 40: words(8, 60) + " " + words(8, 60), 41: None, 42: "", 43: words(7, 30), 44: "ha " * 400, 45: "ha " * 300, 46: words(6, 5000)}
    out = suffix_dedup.repeated_passages(frame(spark, list(texts.items())).repartition(6)).collect()
    got = {i: set() for i in texts}
    for r in out:
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50
    assert got == brute_marks(texts)
    assert all(r.first_doc_id <= r.doc_id and r.first_doc_id in range(12) for r in out if r.doc_id in range(12))


def marked(spark, texts, **options):
    got = {i: set() for i in texts}
    for r in suffix_dedup.repeated_passages(frame(spark, list(texts.items())).repartition(3), **options).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    return got


def test_passages_that_one_document_repeats(spark):
    texts = {}
    for g in range(4):
        p = words(10 * g, 50 + 15 * g)
        texts[2 * g] = " ".join(f"{words(1000 + 100 * g + k, 40)} {p}" for k in range(10)) + " " + words(900 + g, 40)
        texts[2 * g + 1] = f"{words(700 + g, 60)} {p} {words(800 + g, 60)}"
    got = marked(spark, texts)
    assert got == brute_marks(texts) and all(len(got[2 * g]) >= 10 * (50 + 15 * g) for g in range(4))


def test_passages_whose_prefix_is_crowded(spark):
    """Many documents share a prefix, and few of them a passage: parts by longer keys, down to one passage."""
    core, texts = words(1, 24).split(), {}
    tails, heads = [words(50 + k, 40).split() for k in range(5)], [words(80 + k, 40).split() for k in range(4)]
    for k in range(60):
        texts[k] = " ".join([words(2000 + k, 30), *heads[k % 4][k % 7 :], *core, *tails[k % 5][: 40 - k % 11], words(3000 + k, 30)])
    whole = words(5, 70)
    texts |= {100 + k: f"{words(4000 + k, 10 + k)} {whole} {words(5000 + k, 20)}" for k in range(12)}
    expected = brute_marks(texts)
    assert sum(bool(v) for v in expected.values()) > 40
    for block in (1, 5, 20):
        assert marked(spark, texts, block=block) == expected


def test_neighbours_by_definition():
    """Passages by left lengths, from both orders, against all pairs of suffixes."""
    rng = random.Random(3)

    def changed(word, n):
        return "".join((rng.choice("ab") if rng.random() < 0.04 else word) + " " for _ in range(n))

    suffix = {(rng.randrange(3), changed("q", rng.randrange(32)), changed("p", rng.randrange(19, 51))) for _ in range(300)}
    suffix = sorted(suffix, key=lambda s: (s[0], s[2]))
    group, n = np.array([s[0] for s in suffix]), len(suffix)
    rows, first, last, best = suffix_dedup.compared(group, pa.array([s[1] for s in suffix]), pa.array([s[2] for s in suffix]), np.arange(n), np.arange(n), np.arange(n), 50)
    wanted = {}
    for i, (g, a, b) in enumerate(suffix):
        for length in range(32):
            have = (a.split()[:length], b.split()[: 50 - length])
            if (len(have[0]), len(have[1])) != (length, 50 - length):
                continue
            same = [j for j, (h, c, d) in enumerate(suffix) if h == g and (c.split()[:length], d.split()[: 50 - length]) == have]
            if len(same) > 1:
                was = wanted.get(i, (32, -1, i))
                wanted[i] = (min(was[0], length), max(was[1], length), min(was[2], *same))
    assert wanted and {r: (a, b, c) for r, a, b, c in zip(*(x.tolist() for x in (rows, first, last, best)))} == wanted


def test_passages_longer_on_each_side_elsewhere(spark):
    texts = {}
    for g in range(20):
        left, core, right = words(10 * g, 40).split(), words(10 * g + 1, 33).split(), words(10 * g + 2, 40).split()
        for k, (a, b) in enumerate([(40, 40), (9, 8), (16, 0), (0, 16), (14, 2), (2, 14)]):  # all but the second share under 50 words with the first
            texts[10 * g + k] = " ".join([words(5000 + 100 * g + k, 60), *left[40 - a :], *core, *right[:b], words(9000 + 100 * g + k, 60)])
    got = marked(spark, texts)
    assert got == brute_marks(texts) and all(got[10 * g] and got[10 * g + 1] for g in range(20))


def test_passages_odd_rows(spark):
    p = words(1, 80)
    docs = frame(spark, [(1, p), (1, p), (None, p), (2, words(2, 80))]).withColumn("pos", F.lit(1)).withColumn("rid", F.lit(2))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in suffix_dedup.repeated_passages(docs).collect()) == [(False, 1), (True, 0)]
    assert suffix_dedup.repeated_passages(docs.filter("false")).count() == 0


def test_run_hash_is_the_polynomial():
    h = np.array([3, 5, 7, 11, 13, 17, 19, 23, 29, 31], np.uint64)
    for n in (1, 2, 3, 5, 8, 10):
        a = suffix_dedup.run_hash(h, n)
        assert len(a) == 10 - n + 1 and a[0] == suffix_dedup.run_hash(h[:n], n)[0] and len(set(a.tolist())) == len(a)
