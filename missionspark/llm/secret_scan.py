"""Secret scans with multipart credential linking.

Strong patterns stand by themselves.  Weak candidates (an access identifier, a
secret value under a vague name or without a name, an endpoint) are common in
clean text; they are reported only where complementary parts meet: a weak
secret needs an identifier or an endpoint in its scope, an identifier needs a
secret, an endpoint needs both.  A scope is ``SCOPE`` code points and ``LINES``
line ends around a part; an interval join inside the document finds who meets
whom.  Parts that overlap are no company for each other, so no part vouches for
itself: a key word names one kind, and a bare value inside a named part or an
endpoint is that part's text.

Spans are code points, end exclusive, of the whole match.

Defined cases: null text counts as empty and has no span; strong spans never
go away when weak ones are added; a weak span that a strong one covers in part
is not reported again; rows that repeat are scanned alike; a text of any length
is scanned whole, in time that grows with its length (runs of a pattern are
read once: a scheme has at most ``SCHEME`` letters).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points and line ends that two parts of one credential may be apart.
SCOPE, LINES = 300, 3
# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")

#: Letters of an endpoint's scheme.
SCHEME = 16
IDENTIFIER = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""", re.ASCII | re.IGNORECASE)
VALUE = re.compile(r"""\b(?:pwd|pass|auth|credential|private_?key|secret_?(?:access_?)?key|client_?secret)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.ASCII | re.IGNORECASE)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,64}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(rf"""\b(?:[a-z][a-z0-9+.-]{{0,{SCHEME - 1}}}://[^\s"'<>]{{4,}}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{{4,}})""", re.ASCII | re.IGNORECASE)
#: Words without which a named weak pattern can't match, in lower case.
HINTS = ("://", "host", "endpoint", "server", "access", "client", "user", "login", "account", "pwd", "pass", "auth", "credential", "private", "secret")

Span = tuple[int, str, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """The strong spans: leftmost non-overlapping for each kind."""
    low = text.lower() if text.isascii() else text  # a keyword has ASCII letters alone
    found: list[Span] = []
    if not text.isascii() or any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def weak_spans(text: str) -> list[Span]:
    """Candidates that need company; a bare value is none where it overlaps a named one."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        for kind, pattern in (("identifier", IDENTIFIER), ("value", VALUE), ("endpoint", ENDPOINT)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    bare = [(m.start(), "value", m.end()) for m in BARE.finditer(text)]
    return sorted(found + (_outside(bare, [(s, e) for s, _, e in found]) if found else bare))


def near(parts: list[Span], others: list[Span], breaks: list[int]) -> list[bool]:
    """Interval join: which parts have another one inside their scope that doesn't overlap them.

    Of the others that end before a part the last end is nearest, of those that
    start behind it the first start.
    """
    starts, ends = sorted(s for s, _, _ in others), sorted(e for _, _, e in others)

    def meets(a: int, z: int) -> bool:
        return z - a <= SCOPE and bisect_left(breaks, z) - bisect_left(breaks, a) <= LINES

    found = []
    for s, _, e in parts:
        i, j = bisect_right(ends, s), bisect_left(starts, e)
        found.append(i > 0 and meets(ends[i - 1], s) or j < len(starts) and meets(e, starts[j]))
    return found


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak spans whose complementary parts co-occur."""
    weak = weak_spans(text)
    if not weak:
        return []
    taken = [(s, e) for s, _, e in base]
    free = _outside(weak, taken)
    breaks = [m.start() for m in re.finditer("\n", text)]
    names = sorted([w for w in free if w[1] == "identifier"] + [b for b in base if b[1] == "access"])
    places = [w for w in free if w[1] == "endpoint"]
    values = sorted([w for w in free if w[1] == "value"] + [b for b in base if b[1] != "access"])
    sure_values = [v for v, ok in zip(values, near(values, sorted(names + places), breaks)) if ok]
    sure_names = [n for n, ok in zip(names, near(names, sure_values, breaks)) if ok]
    sure_places = [p for p, a, b in zip(places, near(places, sure_values, breaks), near(places, sure_names, breaks)) if a and b]
    strong = set(base)
    return [x for x in sorted({*sure_values, *sure_names, *sure_places}) if x not in strong]


def _outside(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that overlap none of the taken ones, in order of start."""
    taken = sorted(taken)
    starts, reach, top = [s for s, _ in taken], [], -1
    for _, e in taken:
        top = max(top, e)
        reach.append(top)
    return [x for x in spans if not ((i := bisect_left(starts, x[2])) and reach[i - 1] > x[0])]


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans), each by start and then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base), key=lambda s: (s[0], KINDS.index(s[1])))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found."""

    def batches(it):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in it:
            both = [scan(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS[:3]]
            digest = [hashlib.sha256(as_text(base).encode()).hexdigest() for base, _ in both]
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in spans] for _, spans in both]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(digest, pa.string()), pa.array([as_text(spans) for _, spans in both], pa.string()), pa.array(found, kind)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
            )

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, schema)
