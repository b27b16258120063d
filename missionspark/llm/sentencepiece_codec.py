"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The pieces and their log scores come from a model file whose path is a
parameter; nothing is trained.  A text is escaped (a space becomes the marker
U+2581, one marker goes before the text if the model says so) and cut where no
piece can cross: before a marker that follows another character.  In each cut
the best path by summed scores is found; a character that no piece covers is
one unknown unit, scored ten below the least score, and is written as its bytes
where the model has byte pieces.

Defined cases: null or empty text has no pieces and decodes to an empty text; a
text that holds the marker itself decodes to a space there; of paths with equal
scores the one whose last piece starts first wins; the columns beside the id
and the text are not read.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import lean, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Short parts (at most SHORT characters) that a task remembers; more are forgotten together.
REMEMBERED, SHORT = 200_000, 48
#: Short parts, and characters in them, that are worked out together.
PARTS, LETTERS = 20_000, 200_000
#: Texts that a task holds with their pieces at once.
AT_ONCE = 512
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6


class DoubleArray:
    """A trie over bytes in two arrays: child = base[node] + byte + 1, check[child] = node."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [-2], [-1]
        ordered = sorted(keys.items())
        self.free, self.top, open_nodes = 257, 257, [(0, 0, len(ordered), 0)] if ordered else []
        while open_nodes:
            node, low, high, depth = open_nodes.pop()
            if len(ordered[low][0]) == depth:
                self.value[node] = ordered[low][1]
                low += 1
            groups, at = [], low
            while at < high:
                byte, end = ordered[at][0][depth], at + 1
                while end < high and ordered[end][0][depth] == byte:
                    end += 1
                groups.append((byte, at, end))
                at = end
            if not groups:
                continue
            bytes_ = [b for b, _, _ in groups]
            base = self._room(bytes_)
            more = base + 257 - len(self.check)
            if more > 0:
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more
            self.base[node] = base
            for byte, at, end in groups:
                self.check[base + byte + 1] = node
                open_nodes.append((base + byte + 1, at, end, depth + 1))

    def _room(self, wanted: list[int]) -> int:
        """A base whose cells for these bytes are free.

        One child takes the first free cell; several go behind the last one in
        use, and the gaps among them are filled by single children.
        """
        if len(wanted) > 1:
            base = self.top - wanted[0]
            self.top += wanted[-1] - wanted[0] + 1
            return base
        while self.free < len(self.check) and self.check[self.free] != -1:
            self.free += 1
        self.top = max(self.top, self.free + 1)
        return self.free - wanted[0] - 1


@dataclass
class Codec:
    """A model's pieces, ready to encode and decode."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    unknown: int = 0
    memory: dict = field(default_factory=dict)

    def __post_init__(self):
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        self.trie = DoubleArray({self.pieces[i].encode(): i for i in usable})
        self.least = min((self.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.raw = [p.encode() if k in (NORMAL, USER_DEFINED) else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds)]
        crossing = any(MARK in self.pieces[i].lstrip(MARK) for i in usable)
        self.cuts = re.compile("(?s).+" if crossing else f"(?s){MARK}+[^{MARK}]*|[^{MARK}]+")

    def best_path(self, part: str) -> list[int]:
        """Viterbi over the positions of ``part`` that begin a character."""
        b = part.encode()
        n, lost = len(b), float("-inf")
        best, came, last = array("d", [lost]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        at = 0
        while at < n:
            lead = b[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, j, single = best[at], 0, at, False
            while j < n:
                child = base[node] + b[j] + 1
                if check[child] != node:
                    break
                node, j = child, j + 1
                piece = value[node]
                if piece >= 0:
                    score = here + scores[piece]
                    if score > best[j]:
                        best[j], came[j], last[j] = score, at, piece
                    single = single or j == at + width
            if not single and here + self.least > best[at + width]:
                best[at + width], came[at + width], last[at + width] = here + self.least, at, -1
            at += width
        found, z = [], n
        while z:
            a, piece = came[z], last[z]
            if piece >= 0:
                found.append(piece)
            elif self.bytes:
                found += [self.bytes[x] for x in reversed(b[a:z])]
            else:
                found.append(self.unknown)
            z = a
        return found[::-1]

    def escape(self, text: str) -> str:
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def best_paths(self, parts: list[str]) -> list[bytes]:
        """:meth:`best_path` of many parts at once, as bytes of 32-bit numbers.

        All positions walk the trie together; then the ends at one distance
        from their part's start are settled together, in ascending order.
        """
        base, check, value, scores = self.tables()
        codes = [p.encode() for p in parts]
        b = np.frombuffer(b"\0".join(codes) + b"\0", np.uint8)
        size = np.array([len(c) for c in codes])
        start = np.r_[0, np.cumsum(size + 1)[:-1]]
        origin = np.repeat(start, size + 1)
        limit = np.repeat(start + size, size + 1)
        at = np.flatnonzero(((b & 0xC0) != 0x80) & (np.arange(len(b)) < limit))
        source, cursor, node, found = at, at, np.zeros(len(at), np.int64), []
        while len(source):
            inside = cursor < limit[source]
            source, cursor, node = source[inside], cursor[inside], node[inside]
            child = base[node] + b[cursor] + 1
            known = check[child] == node
            source, cursor, node = source[known], cursor[known] + 1, child[known]
            piece = value[node]
            ends = piece >= 0
            found.append((source[ends], cursor[ends], piece[ends]))
        width = np.select([b[at] < 0x80, b[at] < 0xE0, b[at] < 0xF0], [1, 2, 3], 4)
        edge_from, edge_to, piece = (np.concatenate(x) for x in zip(*found)) if found else (at[:0], at[:0], at[:0])
        alone = np.ones(len(b), bool)
        alone[edge_from[edge_to - edge_from == np.select([b[edge_from] < 0x80, b[edge_from] < 0xE0, b[edge_from] < 0xF0], [1, 2, 3], 4)]] = False
        odd = alone[at]
        edge_from, edge_to = np.r_[edge_from, at[odd]], np.r_[edge_to, (at + width)[odd]]
        gain = np.r_[scores[piece], np.full(odd.sum(), self.least)]
        piece = np.r_[piece, np.full(odd.sum(), -1)]
        order = np.lexsort((edge_from, edge_to, edge_to - origin[edge_from]))
        edge_from, edge_to, piece, gain = edge_from[order], edge_to[order], piece[order], gain[order]
        far = edge_to - origin[edge_from]
        best, back = np.full(len(b), -np.inf), np.zeros(len(b), np.int64)
        best[start] = 0.0
        steps = np.flatnonzero(np.r_[True, far[1:] != far[:-1]]) if len(far) else []
        for lo, hi in zip(steps, [*steps[1:], len(far)]):
            score, to = best[edge_from[lo:hi]] + gain[lo:hi], edge_to[lo:hi]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            top = np.maximum.reduceat(score, first)
            winners = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[first, len(to)])))
            winners = winners[np.r_[True, to[winners][1:] != to[winners][:-1]]]
            best[to[first]], back[to[first]] = top, winners + lo
        here, columns = start + size, []
        while True:
            go = here > start
            if not go.any():
                break
            edge = back[here]
            columns.append(np.where(go, piece[edge], -2))
            here = np.where(go, edge_from[edge], here)
        table = np.array(columns[::-1], np.int32).T.copy() if columns else np.empty((len(parts), 0), np.int32)
        unknown = (table == -1).any(axis=1)
        return [np.array(self.best_path(p), np.int32).tobytes() if u else row[row != -2].tobytes() for p, u, row in zip(parts, unknown.tolist(), table)]

    def tables(self) -> tuple[np.ndarray, ...]:
        """The trie and the scores as arrays."""
        if not hasattr(self, "_tables"):
            self._tables = tuple(np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)) + (np.array(self.scores, np.float64),)
        return self._tables

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece numbers of many texts; repeated short parts are worked out once.

        What is remembered has a bound; a long part (a text without spaces is one)
        is worked out by itself and forgotten, in 20 bytes a byte of text.
        """
        cut = [self.cuts.findall(self.escape(t)) if t else [] for t in texts]
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        short = sorted({p for parts in cut for p in parts if len(p) <= SHORT}.difference(memory), key=len)  # alike in length, so that few wait for one
        at = 0
        while at < len(short):
            some = short[at : at + max(1, LETTERS // len(short[min(at + PARTS, len(short)) - 1]))][:PARTS]
            memory.update(zip(some, self.best_paths(some)))
            at += len(some)
        ids = lambda p: memory[p] if len(p) <= SHORT else np.array(self.best_path(p), np.int32).tobytes()
        return [np.frombuffer(b"".join([ids(p) for p in parts]), np.int32) for parts in cut]

    def encode(self, text: str | None) -> np.ndarray:
        """Piece numbers of a text."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of piece numbers."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> Codec:
    """Reads a model file; refuses one whose normaliser this codec doesn't have."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("only models with the identity normaliser are supported")
    unknown = next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), 0)
    return Codec([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], rules.add_dummy_prefix, unknown)


def encode(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, ids, n_pieces, n_bytes (byte pieces), round_trip."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # bounded by the vocabulary

    def batches(it):
        codec = shared.value
        is_byte = np.array([k == BYTE for k in codec.kinds])
        for b in slices(it, AT_ONCE):
            texts = b.column(1).to_pylist()
            ids = codec.encode_all(texts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            same = [codec.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends)), pa.array([int(is_byte[i].sum()) for i in ids], pa.int32()), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_pieces", "n_bytes", "round_trip"],
            )

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(batches), f"doc_id {kind}, ids array<int>, n_pieces int, n_bytes int, round_trip boolean")


def decode(rows: DataFrame, codec: Codec, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids count as none."""
    shared = rows.sparkSession.sparkContext.broadcast(codec)

    def batches(it):
        codec = shared.value
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = rows.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(lean(batches), f"doc_id {kind}, text string")
