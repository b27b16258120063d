"""Text operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from missionspark.llm import html_extract, order_minhash, secret_scan, sentencepiece_codec, toxicity, warc

PAGES = "page_id long, url string, html string"


# --- WARC ---


def payloads():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    return [
        (1, "http://a/1", "<p>é one</p>"), (2, "http://a/2", "<p>é one</p>"), (3, "http://a/3", ""), (4, None, None), (5, "http://a/\r\n5", "x" + fake + "y"), (6, "u", fake), (7, "u", "x" + fake + "y"),
        (8, "u", "WARC/1."), (9, "u", "a\r\n\r\nb\r\n\r\n"), (10, "u", "long " * 40_000 + fake), (None, "u", "<p>é one</p>"), (None, "u", "alone"), (11, "u", "y" * 9), (11, "u", "y" * 9),
    ] + [(100 + k, "u", f"page {k % 40} " * (k % 9)) for k in range(200)]


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    rows = payloads()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several tasks for a file
    try:
        out = warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("value", F.lit("clash")).repartition(3), least_bytes=least).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = (h or "") in first and first[h or ""] != i and len(b) >= least
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out) and all(r.intact for r in out)


def test_warc_of_text_ids(spark):
    rows = [("b", "u", "same"), ("a b>\r\n%41", "u", "same"), ("null", "u", "x WARC/1.1\r\n y"), (None, "u", "same"), ("", "u", "own")]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2)).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in out} == {"a b>\r\n%41": ("response", None), "b": ("revisit", "a b>\r\n%41"), None: ("revisit", "a b>\r\n%41"), "null": ("response", None), "": ("response", None)}
    assert all(r.intact for r in out)


def test_pieces_are_found_however_the_scan_cuts(spark, tmp_path, monkeypatch):
    """The second scan of the files runs with other splits than the first."""
    body = "long " * 3000
    rows = [(k, "u", f"{body}WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{body}WARC/1.{k}") for k in range(12)]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), path)
    sizes, scan = iter(("7000", "40000", "40000")), warc.candidates

    def scanned(spark, path):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return scan(spark, path)

    monkeypatch.setattr(warc, "candidates", scanned)
    try:
        got = {r.record: (r.payload_bytes, r.said == "sha1:" + r.digest) for r in warc.read_archives(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"<urn:page:{k}>": (len(h), True) for k, _, h in rows}


def test_warc_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


# --- main text ---


def test_main_text_cases():
    f = html_extract.main_text
    assert f(None) == f("") == f("<script>x</script>") == ""
    page = (
        '<body><header><h1>Site</h1></header><nav><a>menu</a></nav><div class="cookie-notice">cookies</div><main><h2>Title</h2><p>One&nbsp;two &amp; <b>three</b>\n four<br>five</p><ul><li>a</li><li>b</ul>'
        '<form><input><button>send</button></form><div class="ads">buy</div><aside>side</aside><section id="comments"><p>first!</p></section><table><tr><td>c1</td><td>c2</td></tr></table></main><footer>foot</footer><!-- x --></body>'
    )
    assert f(page) == "Title\n\nOne two & three four five\n\na\n\nb\n\nc1\n\nc2"
    assert f('<p class="header-like">x</p><article><header><h1>kept</h1></header><p>text<footer>no</footer></article>') == "kept\n\ntext"
    assert f("<div><p>only a line") == "only a line"


def test_region_without_an_article():
    words = "many words of running text stand here in one line, "
    page = '<div><a href="1">x</a><a href="2">y</a></div>' * 6 + f"<div id=text><h2>T</h2><p>{words * 4}</p><p>{words * 5}</p><p>short</p></div>" + '<div><a href="1">x</a></div>' * 6
    assert html_extract.main_text(page).split("\n\n") == ["T", (words * 4).strip(), (words * 5).strip(), "short"]


def test_every_article_and_cluster_stays():
    words = "many words of running text stand here in one line, "
    f, p, q = html_extract.main_text, (words * 4).strip(), (words * 6).strip()
    assert f(f'<article><p>{q}</p></article><article><p>{p}</p></article><article class="comment"><p>{p}</p></article>') == f"{q}\n\n{p}"
    cells = "<table>" + "<tr><td><a>1</a></td><td><a>2</a></td></tr>" * 4 + "</table>"
    links = '<div><a href="1">x</a><a href="2">y</a></div>' * 6
    page = f"{links}<div><p>{q}</p><p>{q}</p></div>{cells}<div><p>{p}</p><p>{p}</p></div>{links}"
    assert [b for b in f(page).split("\n\n") if len(b) > 2] == [q, q, p, p]  # a table parts two containers
    page = f"{links}<div><p>{q}</p>{cells}<p>{p}</p></div>{links}"
    assert [b for b in f(page).split("\n\n") if b != "xy"] == [q, *["1", "2"] * 4, p]  # a table of the article; smoothing may take a line beside
    page = f"{links}<div><p>{q}</p><p>{q}</p></div>{links}<article><a>a</a><a>teaser</a></article>{links}"
    assert [b for b in f(page).split("\n\n") if b != "xy"] == [q, q]  # the ratio tells that the mark isn't the text


def test_names_inside_an_article():
    f = html_extract.main_text
    assert f('<article><div class="post-header"><h1>Title</h1></div><p class="share-price">A</p><div class="related-work side-effects"><p>B</p></div></article>') == "Title\n\nA\n\nB"
    outs = ("ads", "share-buttons", "related-posts", "post-comments", "comment-list", "cookie-notice", "x newsletter-signup y", "widget", "notice", "ad_slot")
    assert f("<article><p>A</p>" + "".join(f'<div class="{c}"><p>no</p></div>' for c in outs) + "</article>") == "A"
    assert f('<div class="post-header">no</div><article><p>A</p></article><div class="related-work">no</div>') == "A"


def test_ends_without_starts():
    f = html_extract.main_text
    assert f("<b>x<article></b><p>A <i>b</i></i> c</b></p><p>D</p></article>").endswith("A b c\n\nD")
    assert f("<div><b><div>a</b> b</div></div><p>c</p>") == "a b\n\nc"


def test_pages_of_unclosed_tags_take_time_in_proportion():
    import time

    n = 100_000
    for page in ("<b>" * n + "</i>" * n, "<b>x" * n + "</i>" * n, "<article>" + "<i>" * n + "</b>" * n, "<b><article>" + "<i>x" * n + "</b>" * n, "<div>word " * n, "<p>x" * n, "<div>" * n + "text " * 50 + "</div>" * n, "<div>some text here " * n + "<a>b</a></div>" * n):
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 15, page[:20]


@pytest.mark.parametrize("unit", ["<a ", "<!--", '<a x="', "<a x='y", "</a", "<![CDATA[", "<![x", "<?", "<!x", "<!doctype", "<", "&#", "&a", "<a/", "<a =", "<script></x", "<p", "-->", '<a "', "<svg><"])
def test_what_never_ends_is_looked_at_once(unit):
    import time

    n = 1_000_000 // len(unit)
    for page in (f"<p>{'word ' * 30}</p>" + unit * n, f"<p>{'word ' * 30}</p>" + unit * n + ">"):
        began = time.process_time()
        assert html_extract.main_text(page).startswith("word word")
        assert time.process_time() - began < 15, unit


def test_what_never_ends_takes_the_rest():
    f = html_extract.main_text
    text = ("words of a page " * 6).strip()
    for rest in ("<!-- no end", '<a href="no end', "<div class", "</p", "<![CDATA[ x", "<![if x", "<? x"):
        assert f(f"<p>{text}</p>{rest} <b x") == text
    assert f(f"<p>{text}</p><![foo]><p>{text}</p>") == f"{text}\n\n{text}"


def test_header_of_the_page_inside_main():
    f = html_extract.main_text
    text = ("words of a page " * 6).strip()
    assert f(f"<main><header><p>site header</p></header><article><header><h1>Title</h1></header><p>{text}</p></article></main>") == f"Title\n\n{text}"
    assert f(f"<main><header><h1>Title</h1></header><p>{text}</p></main>") == f"Title\n\n{text}"
    assert f(f"<div role=main><article><p>{text}</p></article><header>late header</header></div>") == text


def brute_seeds(lines, width=1.0):
    """Lines whose smoothed ratio of text to tags is one deviation or more."""
    ratios = [len(t) / max(1, tags) for t, tags, _, _ in lines]
    kernel = {d: math.exp(-0.5 * (d / width) ** 2) for d in range(-3, 4)}
    smooth = [sum(w * ratios[min(len(ratios) - 1, max(0, k + d))] for d, w in kernel.items()) / sum(kernel.values()) for k in range(len(ratios))]
    mean = sum(ratios) / len(ratios)
    return [s >= math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)) - 1e-9 for s in smooth]


def test_method_against_brute_force_and_without_marks(spark, sf_dir):
    """On the given pages the clusters alone find the marked article, and seeds are those of the definition."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        parser = html_extract.Lines()
        bare = re.sub(r"(</?)(?:article|main)\b", r"\1div", r.html)
        assert "<article" not in bare and "<main" not in bare
        parser.feed(bare)
        parser.finish()
        seeds, _ = html_extract.content_lines(parser)
        assert seeds.tolist() == brute_seeds(parser.lines) or not any(brute_seeds(parser.lines))
        assert html_extract.main_text(bare) == html_extract.main_text(r.html)


def test_extract_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html

    for r in html_extract.extract(pages.withColumn("text", F.lit("clash"))).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- secrets ---


def brute_base(text):
    """The base rules, scanned from every start."""
    found, at, keys = [], 0, ("password", "passwd", "secret", "token", "apikey", "api_key")
    rest = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while at < len(text):
        for k in keys:
            if low.startswith(k, at) and (m := rest.match(text, at + len(k))):
                if len(m[1]) >= 6:
                    found.append((at, "assign", m.end()))
                at = m.end() - 1
                break
        at += 1
    for kind, chars, lead, least in (("access", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 20), ("hex", "0123456789abcdef", "", 24)):
        at = 0
        while at < len(text):
            z = at + len(lead)
            if text.startswith(lead, at) and z < len(text) and text[z] in chars:
                while z < len(text) and text[z] in chars:
                    z += 1
                if z - at >= least:
                    found.append((at, kind, z))
                at = z
            else:
                at += 1
    return sorted(found, key=lambda s: (s[0], secret_scan.KINDS.index(s[1])))


def test_base_spans_against_brute_force():
    rng = random.Random(2)
    bits = ["password", "PassWord", "passwd", "secret", "token", "Token", "api_key", "APIKEY", "ſecret", "tokenK", " = ", ":", '"', "'", " ", "abc", "abcdef", "x=y", "AKIA", "AKIA" + "B2" * 9, "0a" * 13, "é", "\n", "A1", "=="]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 12)))
        assert secret_scan.base_spans(text) == brute_base(text), text


def test_weak_parts_need_company():
    kinds = lambda t: [s[1] for s in secret_scan.scan(t)[1]]
    assert kinds("user=bob likes https://a.example/b") == [] and kinds("pwd=hunter22") == [] and kinds("login: bob") == []
    assert kinds("login: bob pwd=hunter22") == ["identifier", "value"]
    assert kinds("login: bob" + " far" * 200 + " pwd=hunter22") == []
    assert kinds("host=db.local user=bob\npwd=hunter22") == ["endpoint", "identifier", "value"]
    assert kinds("login: bob\n\n\n\n\npwd=hunter22") == []


def test_a_part_is_no_company_for_itself():
    kinds = lambda t: [s[1] for s in secret_scan.scan(t)[1]]
    assert kinds("access_key=abcdef123") == [] and kinds("secret_access_key=abcdef123") == [] and kinds("https://a.example/?user=bob") == []
    bare = "Ab1" * 12
    assert kinds(bare) == kinds(f"user={bare}") == kinds(f"https://a.example/{bare}") == []
    assert kinds(f"user=bob {bare}") == ["identifier", "value"]
    assert kinds("access_key=abcdef123 secret_access_key=Zz9+abcdef") == ["identifier", "value"]
    assert kinds("https://a.example/?user=bob&pwd=hunter22") == ["identifier", "value"]  # the endpoint holds both and has no part beside it


def test_interval_join_against_all_pairs():
    rng = random.Random(4)
    seen = set()
    for _ in range(600):
        spans = lambda n: sorted((s, "x", s + rng.randint(1, 400)) for s in rng.sample(range(4000), n))
        a, b, breaks = spans(8), spans(rng.randint(0, 6)), sorted(rng.sample(range(4000), 40))
        a = sorted(a + b[:2])  # parts that are among the others, too

        def ok(p, q):
            if p[0] < q[2] and q[0] < p[2]:
                return False
            x, z = min(p[2], q[2]), max(p[0], q[0])
            return z - x <= secret_scan.SCOPE and sum(x <= k < z for k in breaks) <= secret_scan.LINES

        want = [any(ok(p, q) for q in b) for p in a]
        assert secret_scan.near(a, b, breaks) == want
        seen |= set(want)
    assert seen == {True, False}


def brute_linked(text):
    """The rules of company over all pairs of parts."""
    base = brute_base(text)
    over = lambda p, q: p[0] < q[2] and q[0] < p[2]
    meet = lambda p, q: not over(p, q) and max(p[0], q[0]) - min(p[2], q[2]) <= secret_scan.SCOPE and text[min(p[2], q[2]) : max(p[0], q[0])].count("\n") <= secret_scan.LINES
    named = [(m.start(), k, m.end()) for k, x in (("identifier", secret_scan.IDENTIFIER), ("value", secret_scan.VALUE), ("endpoint", secret_scan.ENDPOINT)) for m in x.finditer(text)]
    bare = [(m.start(), "value", m.end()) for m in secret_scan.BARE.finditer(text)]
    weak = {w for w in named + [x for x in bare if not any(over(x, n) for n in named)] if not any(over(w, b) for b in base)}
    names = {w for w in weak if w[1] == "identifier"} | {b for b in base if b[1] == "access"}
    places, values = {w for w in weak if w[1] == "endpoint"}, {w for w in weak if w[1] == "value"} | {b for b in base if b[1] != "access"}
    values = {v for v in values if any(meet(v, x) for x in names | places)}
    names = {n for n in names if any(meet(n, v) for v in values)}
    places = {p for p in places if any(meet(p, v) for v in values) and any(meet(p, n) for n in names)}
    return sorted(set(base) | ((values | names | places) & weak), key=lambda s: (s[0], secret_scan.KINDS.index(s[1])))


def test_linked_spans_against_brute_force():
    rng = random.Random(8)
    bits = ["user=bob1 ", "login: amy2\n", "access_key=abcdef123 ", "secret_key=abcdef99 ", "pwd=hunter22 ", "auth: zzzzzz\n", "host=db.local ", "https://a.example/x?pwd=secret123 ", "Ab1" * 12 + " ", "AKIA" + "B2" * 9 + " ", "0a" * 13 + " ", "token=abcdefgh ", "word " * 20, "\n\n\n\n", "é "]
    some = 0
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randint(1, 10)))
        assert secret_scan.scan(text)[1] == brute_linked(text), text
        some += len(secret_scan.scan(text)[1]) > len(brute_base(text))
    assert some > 200


def test_long_texts_are_scanned_in_their_length():
    import time

    for text in ("user " + "a." * 500_000, "pass" + " " * 1_000_000, "user=" * 200_000, "Ab1" * 330_000, "token" * 200_000, "host:" * 200_000, "http://" * 140_000, "user=bob pwd=hunter22 " * 40_000):
        began = time.process_time()
        secret_scan.scan(text)
        assert time.process_time() - began < 4, text[:20]


def test_secret_rows(spark):
    key = "a1" * 20
    docs = spark.createDataFrame([(1, None), (2, ""), (3, f'éé token = "{key}"'), (3, f'éé token = "{key}"'), (None, "clean")], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = {(r.doc_id, r.spans): r for r in secret_scan.secret_spans(docs).collect()}
    assert out[(3, "assign:3:52,hex:12:52")].base_sha256 == hashlib.sha256(b"assign:3:52,hex:12:52").hexdigest()
    assert out[(1, "")].base_sha256 == hashlib.sha256(b"").hexdigest() and out[(None, "")].n_hex == 0


# --- toxicity ---


def brute_segments(hits, drift):
    """All maximal segments by their definition: the best one, then both sides of it."""
    if not hits:
        return []
    best = None
    for i, j in itertools.combinations_with_replacement(range(len(hits)), 2):
        score = sum(s for _, s in hits[i : j + 1]) - drift * (hits[j][0] - hits[i][0] - (j - i))
        if best is None or score > best[0] + 1e-12 or abs(score - best[0]) <= 1e-12 and j - i < best[2] - best[1]:
            best = (score, i, j)
    score, i, j = best
    return brute_segments(hits[:i], drift) + [(hits[i][0], hits[j][0], score)] + brute_segments(hits[j + 1 :], drift)


def test_maximal_segments_against_definition():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(200), rng.randint(0, 12)))
        hits = [(p, rng.choice([1.0, 1.7, 3.3])) for p in places]
        got = toxicity.segments(hits, 0.21)
        assert [(a, z) for a, z, _ in got] == [(a, z) for a, z, _ in brute_segments(hits, 0.21)]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in brute_segments(hits, 0.21)])


def test_rate_solves_its_equation():
    p, s = np.array([1e-4, 1e-3]), np.array([4.0, 2.0])
    x = toxicity.solve_rate(0.05, p, s)
    assert (1 - p.sum()) * np.exp(-0.05 * x) + (p * np.exp(x * s)).sum() == pytest.approx(1, abs=1e-6)


def test_curve_of_separable_rows_is_finite():
    x, y = np.array([[0.0, 0.0]] * 900 + [[3.0, 2.0]] * 100), np.array([0.0] * 900 + [1.0] * 100)
    w = toxicity.fit_curve(x, y)
    assert toxicity.logistic(w, (0, 0)) < 0.05 and toxicity.logistic(w, (3, 2)) > 0.95


def test_held_out_toxicity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, labels = [], []
    for i in range(900):
        own = [word() for _ in range(rng.randint(20, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 6)):
                own.insert(rng.randrange(len(own)), rng.choice(["Nasty", "vile" + word(), "foulness"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "nasty nasty vilex"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(None, 1), (7, None), (12, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900 and r.doc_id != 5]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.97
    kept = toxicity.clean_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in out)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.score(docs, model).collect()} == {0.0 if not model.terms and model.curve[0] < -10 else round(toxicity.logistic(model.curve, (0, 0)), 6)}
    assert toxicity.score(docs.filter("false"), model).count() == 0


# --- SentencePiece ---


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.load()


def best_score(codec, text, memory=None):
    """The greatest sum of scores over all ways to cut a text."""
    memory = {} if memory is None else memory
    if text not in memory:
        known = {codec.pieces[i]: codec.scores[i] for i, k in enumerate(codec.kinds) if k in (1, 4)} if "known" not in memory else memory["known"]
        memory["known"] = known
        options = [known[text[:n]] + best_score(codec, text[n:], memory) for n in range(1, min(len(text), 20) + 1) if text[:n] in known]
        if text and text[0] not in known:
            options.append(codec.least + best_score(codec, text[1:], memory))
        memory[text] = max(options) if text else 0.0
    return memory[text]


def test_viterbi_is_the_best_cut(codec):
    rng = random.Random(6)
    scores = codec.scores
    for _ in range(150):
        part = "▁" + "".join(rng.choice("thearinésß☃ꙮq") for _ in range(rng.randint(1, 9)))
        ids = codec.best_path(part)
        plain = sum(scores[i] for i in ids if codec.kinds[i] != 6)
        strange = sum(c not in codec.pieces for c in part)
        assert plain + strange * codec.least == pytest.approx(best_score(codec, part))
        assert np.frombuffer(codec.best_paths([part])[0], np.int32).tolist() == ids


def test_viterbi_is_the_librarys_lattice(codec):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(sentencepiece_codec.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    lib = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    for text in ("Is and retitioning ouen of the", "hested the.", "naïve Straße 12%", "a  b   c"):
        ours, theirs = codec.encode(text).tolist(), lib.nbest_encode(text, nbest_size=1)[0]
        assert sum(codec.scores[i] for i in ours) >= sum(codec.scores[i] for i in theirs)
        assert codec.decode(ours) == lib.decode(theirs) == text


def test_long_parts_are_not_remembered(codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 3)
    codec.memory.clear()
    long = "abcdefghij" * 20_000
    for text in (long, "a b c d e f", "é" * 60, "g h"):
        assert codec.decode(codec.encode(text).tolist()) == text
    assert all(len(p) <= sentencepiece_codec.SHORT for p in codec.memory) and len(codec.memory) <= 12
    assert codec.encode("x" * 30 + "é☃y" * 9).tolist() == codec.encode(None).tolist() + codec.encode("x" * 30 + "é☃y" * 9).tolist()


def test_encoding_rows_round_trip(spark, codec):
    texts = [None, "", " ", "a", "  two  spaces ", "日本 ☃ \U0001f600", "\n\ttabs", "x" * 5000, "é" * 300, "many words " * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = sentencepiece_codec.encode(docs, codec)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in out.collect())
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(out.filter("doc_id is not null"), codec).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert codec.decode(codec.encode("a▁b").tolist()) == "a b"


def test_double_array_knows_its_keys_alone():
    rng = random.Random(9)
    keys = {bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(1, 6))): i for i in range(200)}
    trie = sentencepiece_codec.DoubleArray(keys)

    def get(key):
        node = 0
        for b in key:
            child = trie.base[node] + b + 1
            if child >= len(trie.check) or trie.check[child] != node:
                return -1
            node = child
        return trie.value[node]

    assert all(get(k) == v for k, v in keys.items())
    assert all(get(k) == keys.get(k, -1) for k in (bytes(rng.choices(b"abcd", k=rng.randint(1, 7))) for _ in range(500)))


# --- Order MinHash ---


def brute_signature(text):
    """The slots by their definition, from numbered k-mers in lists."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return [0] * order_minhash.SLOTS
    low = ~np.uint64((1 << order_minhash.PLACE) - 1)
    seen, ring = {}, []
    for place, h in enumerate(order_minhash.kmers(points)):
        h = h & low
        n = seen[int(h)] = seen.get(int(h), -1) + 1
        x = h if not n else order_minhash._mix(np.array([h + np.uint64(n) * np.uint64(order_minhash.P)], np.uint64))[0] & low
        ring.append((int(x), place))
    ring.sort()
    out = []
    for j, factor in enumerate(order_minhash.FACTORS.tolist()):
        two = sorted(ring, key=lambda r: r[0] * factor % (1 << 64))[:2]
        a, b = sorted((two * 2)[:2], key=lambda r: r[1])
        a, b = np.array([a[0]], np.uint64), np.array([b[0]], np.uint64)
        out.append(int((order_minhash._mix(order_minhash._mix(a) * np.uint64(3) + order_minhash._mix(b + np.uint64(1)) + np.uint64(j)) >> np.uint64(48))[0]))
    return out


def test_signature_by_definition():
    with np.errstate(over="ignore"):
        for text in ("", "a", "abcdefgh", "abcabcabcabcabcabc", "the quick brown fox jumps over the lazy dog " * 3, "é☃" * 20, "abcdefghi", "".join(chr(97 + k * k % 23) for k in range(9000))):
            assert order_minhash.fingerprint(text).tolist() == brute_signature(text), text


def test_slots_are_independent():
    """The share of equal slots has the spread of 64 independent draws, not that of neighbours on one ring."""
    rng = random.Random(3)
    same = []
    for _ in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
        other = [w if k % 30 else "edited" for k, w in enumerate(words)]
        same.append(order_minhash.likeness(order_minhash.fingerprint(" ".join(words)), order_minhash.fingerprint(" ".join(other))))
    p = np.mean(same)
    assert 0.5 < p < 0.95 and np.std(same) < 1.6 * (p * (1 - p) / order_minhash.SLOTS) ** 0.5


def test_ids_of_text(spark):
    rows = [(f"id-{i:03d}", f"text number {i} " * (1 + i % 4)) for i in range(80)] + [(None, "last")]
    out = order_minhash.edit_report(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    ordered = sorted((r for r in rows if r[0]), reverse=True) + [rows[-1]]
    assert len(out) == len(rows)
    for (i, text), (_, other) in zip(ordered, ordered[1:] + ordered[:1]):
        got = next(r for r in out if r.doc_id == i)
        assert got.edited_sha256 == hashlib.sha256(order_minhash.edited(text, other).encode()).hexdigest()


def test_position_among_bounds(spark):
    df = spark.range(0, 40).select(order_minhash.position(F.col("id"), [0, 3, 4, 9, 30]).alias("n"), "id")
    assert all(r.n == sum(b <= r.id for b in (0, 3, 4, 9, 30)) for r in df.collect())


def test_order_matters_and_edits_cost():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    f = lambda w: order_minhash.fingerprint(" ".join(w))
    base, few, moved = f(words), f(words[:50] + ["new"] + words[51:]), f(words[100:] + words[:100])
    other = f(["".join(rng.choice("ijklmnop") for _ in range(5)) for _ in range(200)])
    assert order_minhash.likeness(base, few) > order_minhash.likeness(base, moved) > order_minhash.likeness(base, other)


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(i, f"text number {i} " * (i % 5)) for i in range(60)] + [(7, "repeat"), (7, "repeat"), (None, None), (None, "n"), (90, None), (91, "x" * 50_000)]])
def test_edit_report_by_one_list(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit(1)).withColumn("bucket", F.lit("x"))
    out = order_minhash.edit_report(docs.repartition(5)).collect()
    assert len(out) == len(rows)
    ordered = [r for r in sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))]
    for (i, text), (_, other) in zip(ordered, ordered[1:] + ordered[:1]):
        if sum(r[0] == i for r in rows) > 1 or other is not None and sum(r[1] == other for r in rows) > 1 or other is None and rows[-1][0] == 91 and i == 0:
            continue  # neighbours of repeated ids follow the digest's order
        got = next(r for r in out if r.doc_id == i)
        changed = order_minhash.edited(text or "", other or "")
        f, g, h = (order_minhash.fingerprint(x) for x in (text or "", changed, other or ""))
        assert got.n_chars == len(text or "")
        if i not in (8,):  # its next is the repeated id
            assert got.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert (got.fingerprint, got.edited_fingerprint) == (order_minhash.as_text(f), order_minhash.as_text(g))
            assert (got.near_edited, got.near_next) == (order_minhash.likeness(f, g), order_minhash.likeness(f, h))
