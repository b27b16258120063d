"""The registered queries and the pipeline on the given tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from missionspark.llm import queries

from ..oracle import assert_same, connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connection(sf_dir), queries.oracle_sql()[name])


def test_stages(spark, sf_dir):
    from missionspark.llm import exact_dedup, mixing, toxicity
    from missionspark.llm.storage import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "test")
        rows = docs.collect()
        kept[name] = [r.doc_id for r in rows]
        if name != "sentencepiece":
            assert docs.columns == columns and all(seen[r.doc_id] == r.text for r in rows)
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert sorted(kept[name]) == sorted(r.doc_id for r in toxicity.score(before, model).filter("predicted = 0").collect())
        if name == "exact dedup":
            assert sorted(kept[name]) == sorted(r.doc_id for r in exact_dedup.exact_dedup(before).filter("kept").collect())
        if name == "mixing":
            want = {r.doc_id: r.repeats for r in mixing.mix(before).collect()}
            assert all(kept[name].count(i) == n for i, n in want.items())
        if name == "sentencepiece":
            assert sorted(kept[name]) == sorted(kept["mixing"]) and all(r.round_trip for r in rows)
    assert len(set(kept["toxicity"])) > len(set(kept["exact dedup"])) >= len(set(kept["simhash near-dedup"]))
