"""Cross-tokenizer alignment by products of token-byte incidence matrices.

Two tokenizers cut the same bytes differently.  With ``A`` and ``B`` the 0/1
matrices of tokens by bytes, ``A * B^T`` holds for every pair of token
occurrences the number of bytes that they share: its entries are the overlap
links.  Byte offsets where tokens of both end cut a text into groups; with the
token-by-group matrices ``U`` and ``V``, ``U * V^T`` holds the pairs that share a
group.  All matrices are compressed sparse rows made here, and the products are
Gustavson's: a row of the result gathers the rows of the right matrix that its
own entries name.  They are taken a span of rows at a time, so that memory is
bounded by the span and not by the square of a group.

A link's count is the number of links of the whole corpus that hold its pair of
ids.  Documents keep their distinct pairs with the times they occur; counts are
summed before the shuffle.  Pairs of high counts, as many as fit the broadcast
bound, are joined where the documents are read; the rest, which is rare by
construction, is joined by shuffle.  So frequent pairs never meet in one task.

Defined cases: null and empty texts, and texts whose joined token bytes differ
from a space and the text, have no tokens and an empty digest; strings of
special tokens are plain text; null and repeated identifiers are documents like
any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_codec import MARK
from .storage import materialise, release

BYTE_MODEL, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how byte-level models cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that a task aligns together, products that are held at once, and id pairs that are broadcast.
TOGETHER, PRODUCTS, BROADCAST_PAIRS = 1 << 20, 1 << 20, 1 << 19
SHIFT = 32
#: A space between two that are no white space starts a word of both tokenizers, so what lies between such cuts is aligned by itself.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Short parts (at most SHORT characters) that a task remembers with their alignment.
REMEMBERED, SHORT = 150_000, 48
#: Parts that are encoded as one text.
JOINED = 256


@dataclass
class Rows:
    """A sparse matrix in compressed rows: row i has columns[starts[i] : starts[i + 1]]."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @staticmethod
    def spans(ends: np.ndarray) -> "Rows":
        """Row i has a one for each byte from the end of row i - 1 to its own."""
        total = int(ends[-1]) if len(ends) else 0
        return Rows(np.r_[0, ends], np.arange(total), total)

    @staticmethod
    def labels(label: np.ndarray, width: int) -> "Rows":
        """Row i has a one at its label."""
        return Rows(np.arange(len(label) + 1), label, width)

    def transposed(self) -> "Rows":
        """Counting sort of the entries by column."""
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return Rows(np.r_[0, np.cumsum(np.bincount(self.columns, minlength=self.width))], rows[np.argsort(self.columns, kind="stable")], len(self.starts) - 1)

    def times(self, other: "Rows", at_once: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gustavson's product, as (rows, columns, values) of spans of rows in ascending order."""
        widths = np.diff(other.starts)[self.columns]  # how long a row each entry names
        work = np.r_[0, np.cumsum(widths)]
        upto, n, row = work[self.starts], len(self.starts) - 1, 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(upto, upto[row] + at_once, "right")) - 1)
            lo, hi = self.starts[row], self.starts[end]
            made = int(work[hi] - work[lo])
            of = np.repeat(np.repeat(np.arange(row, end), np.diff(self.starts[row : end + 1])), widths[lo:hi])
            inside = np.arange(made) - np.repeat(work[lo:hi] - work[lo], widths[lo:hi])
            found = other.columns[np.repeat(other.starts[self.columns[lo:hi]], widths[lo:hi]) + inside]
            code = of * other.width + found
            if made and (code[1:] < code[:-1]).any():
                code = np.sort(code)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if made else np.empty(0, np.int64)
            yield code[first] // other.width, code[first] % other.width, np.diff(np.r_[first, made])
            row = end


@dataclass
class Tokenizer:
    """A vocabulary whose ids stand for bytes."""

    raw: list[bytes]
    encode: object

    def __post_init__(self):
        self.length = np.array([len(x) for x in self.raw])


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable ones for themselves, others counted on from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_bpe(content: bytes) -> Tokenizer:
    """A byte-level model; refuses one whose merges don't stand in the order of their ids."""
    import tiktoken

    model = json.loads(content)
    special = {t["id"] for t in model.get("added_tokens", ())}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [model["model"]["vocab"][a + b] for a, b in merges]
    if made != sorted(made) or len(set(made)) + 256 != len(ranks) or model.get("normalizer"):
        raise ValueError("only byte-level models whose ids follow their merges are supported")
    raw = [b""] * (1 + max(model["model"]["vocab"].values()))
    for token, i in ranks.items():
        raw[i] = token
    encoder = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(texts: list[str]) -> list[list[int]]:
        found = []
        for t in texts:
            try:
                found.append(encoder.encode_ordinary(" " + t))
            except (ValueError, RuntimeError):  # a run of white space too long for its pattern
                if not slow:
                    import tokenizers

                    slow.append(tokenizers.Tokenizer.from_str(content.decode()))
                    slow[0].encode_special_tokens = True
                found.append(slow[0].encode(" " + t, add_special_tokens=False).ids)
        return found

    return Tokenizer(raw, encode)


def piece_bpe(content: bytes) -> Tokenizer:
    """A model of pieces that puts a space before the text; refuses one with pieces that go on after a word's end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    if any(MARK in p.lstrip(MARK) for p in map(model.id_to_piece, range(model.get_piece_size()))):
        raise ValueError("only models whose pieces stay inside a word are supported")
    raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    return Tokenizer(raw, lambda texts: model.encode(texts, num_threads=1))


@lru_cache(maxsize=2)
def tokenizers_of(byte_model: bytes, piece_model: bytes) -> tuple[Tokenizer, Tokenizer]:
    """Both tokenizers, built once in a worker."""
    return byte_bpe(byte_model), piece_bpe(piece_model)


@dataclass
class Aligned:
    """Texts with tokens of both, one after the other."""

    a: np.ndarray
    b: np.ndarray
    #: First token of each text in a and b, and first group.
    a_at: np.ndarray
    b_at: np.ndarray
    #: Group of each token, and the number of groups.
    a_group: np.ndarray
    b_group: np.ndarray
    groups: int
    #: Byte offsets where tokens of each end, and where both do.
    ends: tuple[np.ndarray, np.ndarray]
    cuts: np.ndarray

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a token, b token, bytes that they share), by a token."""
        return Rows.spans(self.ends[0]).times(Rows.spans(self.ends[1]).transposed())

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a token, b token, 1) of every pair in one group, by a token."""
        return Rows.labels(self.a_group, self.groups).times(Rows.labels(self.b_group, self.groups).transposed())


def align(a: list[list[int]], b: list[list[int]], left: Tokenizer, right: Tokenizer) -> Aligned:
    """Aligns the tokens of texts, each text's of equal bytes."""
    ids = [np.array(list(chain.from_iterable(side)), np.int64) for side in (a, b)]
    at = [np.r_[0, np.cumsum([len(x) for x in side])].astype(np.int64) for side in (a, b)]
    ends = [np.cumsum(t.length[x]) if len(x) else x for t, x in zip((left, right), ids)]
    cuts = ends[0][np.isin(ends[0], ends[1])]
    group = [np.searchsorted(cuts, e) for e in ends]
    return Aligned(*ids, *at, *group, len(cuts), (ends[0], ends[1]), cuts)


def joined(ids: list[int], tokenizer: Tokenizer) -> bytes:
    return b"".join(map(tokenizer.raw.__getitem__, ids))


def parts_of(parts: list[str], left: Tokenizer, right: Tokenizer) -> list[tuple]:
    """(numbers, groups, pairs) of each part with the space before it.

    The numbers are n_a, n_b, n_groups, n_links, n_shared and whether the bytes of
    both are those of the part, as bytes of 64-bit numbers like the pairs; groups
    is text.  Parts that begin and end with a character are encoded together, as a text
    that would be cut into them.
    """
    plain = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace() and MARK not in p]
    rest = set(parts).difference(plain)
    pieces = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)] + [[p] for p in parts if p in rest]
    out, good = {}, []
    texts = [" ".join(p) for p in pieces]
    for piece, text, x, y in zip(pieces, texts, left.encode(texts), right.encode(texts)):
        if joined(x, left) == (" " + text).encode() == joined(y, right):
            good.append((piece, x, y))
        elif len(piece) == 1:
            out[piece[0]] = (bytes(48), "", b"")
        else:  # each for itself
            out.update((p, parts_of([p], left, right)[0]) for p in piece)
    order = [p for piece, _, _ in good for p in piece]
    found = align([x for _, x, _ in good], [y for _, _, y in good], left, right)
    upto = np.cumsum([len(p.encode()) + 1 for p in order], dtype=np.int64)
    a_at, b_at, group_at = (np.r_[0, np.searchsorted(ends, upto, "right")] for ends in (*found.ends, found.cuts))
    pairs, tokens = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j, _ in found.links():
        pairs.append(found.a[i] << SHIFT | found.b[j])
        tokens.append(i)
    pairs, link_at = np.concatenate(pairs), np.searchsorted(np.concatenate(tokens), a_at)
    in_group = np.r_[0, np.cumsum(np.bincount(found.a_group, minlength=found.groups) * np.bincount(found.b_group, minlength=found.groups))]
    sides = []
    for ids, group in ((found.a, found.a_group), (found.b, found.b_group)):
        edge, names = np.searchsorted(group, np.arange(found.groups + 1)).tolist(), list(map(str, ids.tolist()))
        sides.append([names[x] if y == x + 1 else ",".join(names[x:y]) for x, y in zip(edge, edge[1:])])
    groups = list(map("|".join, zip(*sides)))
    numbers = np.ones((len(order), 6), np.int64)
    numbers[:, :5] = np.diff([a_at, b_at, group_at, link_at, in_group[group_at]]).T
    texts = [";".join(groups[x:y]) for x, y in pairwise(group_at.tolist())]
    raw, edge, plain = pairs.tobytes(), (8 * link_at).tolist(), numbers.tobytes()
    out.update(zip(order, zip([plain[x : x + 48] for x in range(0, len(plain), 48)], texts, [raw[x:y] for x, y in pairwise(edge)])))
    return [out[p] for p in parts]


class Memory:
    """Short parts and what is known of them: those met lately, and those met before that."""

    def __init__(self):
        self.late: dict = {}
        self.early: dict = {}

    def known(self, parts: list[str], work_out) -> list[tuple]:
        """What is known of each part; new ones are worked out together."""
        late, early = self.late, self.early
        found = [late.get(p) or early.get(p) for p in parts]
        new = [p for p, x in zip(parts, found) if x is None]
        told = dict(zip(new, work_out(new)))
        found = [told[p] if x is None else x for p, x in zip(parts, found)]
        late.update((p, x) for p, x in zip(parts, found) if len(p) <= SHORT)
        if len(late) > REMEMBERED:
            self.late, self.early = {}, late
        return found


def rows_of(texts: list[str | None], left: Tokenizer, right: Tokenizer, memory: Memory) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, times) of each text.

    A text is put together from its parts; those of this call are aligned at once,
    and short ones are remembered.
    """
    cut = [CUT.split(t) if t else [] for t in texts]
    every = list(chain.from_iterable(cut))
    local = {p: i for i, p in enumerate(dict.fromkeys(every))}
    which = np.array(list(map(local.__getitem__, every)), np.int64)
    known = memory.known(list(local), lambda new: parts_of(new, left, right))
    numbers, groups, pairs = zip(*known) if known else ((), (), ())
    numbers = np.frombuffer(b"".join(numbers), np.int64).reshape(-1, 6)
    flat, starts = np.frombuffer(b"".join(pairs), np.int64), np.r_[0, np.cumsum(numbers[:, 3])]
    out, at = [], 0
    for parts in cut:
        here, at = which[at : at + len(parts)], at + len(parts)
        if not len(here) or not numbers[here, 5].all():
            out.append((0, 0, 0, 0, 0, "", (), ()))
            continue
        digest = hashlib.sha256(";".join([groups[i] for i in here.tolist()]).encode()).hexdigest()
        each, often = np.unique(here, return_counts=True)
        width = numbers[each, 3]
        code = flat[np.repeat(starts[each] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        out.append((*numbers[here, :5].sum(axis=0).tolist(), digest, code[first], np.add.reduceat(np.repeat(often, width)[order], first)))
    return out


def portions(batches, limit: int = TOGETHER):
    """(identifiers, texts) of few texts or one long one."""
    for b in batches:
        size = np.cumsum(b.column(2).to_numpy())
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
            part = b.slice(lo, hi - lo)
            yield part.column(0), part.column(1).to_pylist()
            lo = hi


def token_pairs(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, distinct pairs of ids and the times that they are linked."""
    contents = []
    for path in (byte_model, piece_model):
        with open(path, "rb") as f:
            contents.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(contents))  # bounded by the vocabularies

    def tasks(batches):
        (left, right), memory = tokenizers_of(*shared.value), Memory()
        for ids, texts in portions(batches):
            rows = rows_of(texts, left, right, memory)
            columns = list(zip(*rows))
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in c])].astype(np.int32)), pa.array(np.concatenate([np.asarray(x, np.int64) for x in c]))) for c in columns[6:]]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(tasks, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs array<long>, times array<long>")


def link_table(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, doc_id: str = "doc_id", text: str = "text", shared_groups: bool = False) -> DataFrame:
    """One row a link: doc_id, a_token, b_token (places in the text), a_id, b_id, value.

    ``value`` is the number of shared bytes.  With ``shared_groups`` the links are
    the pairs that share a group and the value is 1.
    """
    contents = []
    for path in (byte_model, piece_model):
        with open(path, "rb") as f:
            contents.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(contents))
    schema = f"doc_id {docs.select(F.col(doc_id)).schema[0].dataType.simpleString()}, a_token long, b_token long, a_id long, b_id long, value long"

    def tasks(batches):
        left, right = tokenizers_of(*shared.value)
        for ids, texts in portions(batches):
            for k, t in enumerate(texts):
                a, b = (x.encode([t]) if t else [[]] for x in (left, right))
                want = (" " + (t or "")).encode()
                if joined(a[0], left) != want or joined(b[0], right) != want:
                    continue
                found = align(a, b, left, right)
                for i, j, value in found.shared_groups() if shared_groups else found.links():
                    yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(i), np.int32)), ids.slice(k, 1)).dictionary_decode(), *map(pa.array, (i, j, found.a[i], found.b[j], value))], ["doc_id", "a_token", "b_token", "a_id", "b_id", "value"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes")).mapInArrow(tasks, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): links of the corpus by pair of ids, and whether the right id has no pair of more."""
    each = links.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("count"))
    counts = materialise(each.withColumnRenamed("pairs", "pair"), "alignment-counts")
    right = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    tops = counts.groupBy(right.alias("right")).agg(F.max("count").alias("top"))  # bounded by the right vocabulary
    found = materialise(counts.join(F.broadcast(tops), right == F.col("right")).select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "alignment-pairs")
    release(counts)
    return found


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach with their counts."""
    levels = {r.level: r["n"] for r in counts.groupBy(F.floor(F.log2("count")).alias("level")).agg(F.count("*").alias("n")).collect()}
    level, held = 63, 0
    while level > 0 and held + levels.get(level - 1, 0) <= most:
        level -= 1
        held += levels.get(level, 0)
    return 1 << level


def alignment(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, doc_id: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared."""
    links = materialise(token_pairs(docs, byte_model, piece_model, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "alignment-links")
    counts = pair_counts(links)
    least = frequent_from(counts, broadcast_pairs)
    named = counts.withColumnRenamed("pair", "of")
    each = links.select("row", F.inline(F.arrays_zip("pairs", "times")))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    probed = each.join(F.broadcast(named.filter(F.col("count") >= least)), F.col("pairs") == F.col("of"), "left")
    parts = materialise(probed.filter("of is not null").groupBy("row").agg(*sums), "alignment-frequent")
    if least > 1:
        rare = materialise(probed.filter("of is null").select("row", "pairs", "times"), "alignment-rare")
        tail = rare.join(named.filter(F.col("count") < least).hint("merge"), F.col("pairs") == F.col("of")).groupBy("row").agg(*sums)
        parts = parts.unionByName(tail).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    parts = parts.withColumnRenamed("row", "at")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = links.drop("pairs", "times").join(parts, F.col("row") == F.col("at"), "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256", "n_shared")
    found = materialise(found, "alignment")
    release(links, counts)
    return found
