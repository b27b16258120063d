from __future__ import annotations

import pyarrow as pa

from missionspark.llm import batches, sentencepiece_codec


def test_lean_gives_back_and_keeps_all_batches(monkeypatch):
    calls = []
    monkeypatch.setattr(batches, "give_back", lambda: calls.append(1))
    rows = [pa.RecordBatch.from_arrays([pa.array([k])], ["x"]) for k in range(20)]
    assert list(batches.lean(iter)(rows)) == rows
    assert len(calls) == 3  # after 8, after 16, at the end


def test_parts_worked_out_together_are_bounded(monkeypatch):
    codec = sentencepiece_codec.load()
    sizes, best = [], codec.best_paths
    monkeypatch.setattr(codec, "best_paths", lambda parts: sizes.append(sum(map(len, parts))) or best(parts))
    text = " ".join(f"{k:047d}" for k in range(6000)) + " a b c"
    (ids,) = codec.encode_all([text])
    assert max(sizes) <= sentencepiece_codec.LETTERS
    assert codec.decode(ids.tolist()) == text
