from __future__ import annotations

import pytest

import __spark_entry__ as entry
from missionspark.plans import catalogue

from .oracle import assert_same, connection

WITHOUT_SQL = sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, sf_dir, name):
    assert_same(entry.queries()[name](spark, sf_dir), connection(sf_dir), catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "place"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_subtitles_are_whole_texts(spark, sf_dir):
    texts = {r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text").collect() if r.text}
    found = [r.subtitle for r in entry.queries()["j15_whole_subtitles"](spark, sf_dir).collect() if r.subtitle]
    assert found and all(any(s.startswith(x) for x in texts) and any(s.endswith(x) for x in texts) for s in found)
    assert max(map(len, found)) > 100


def test_prototypes_have_all_dimensions(spark, sf_dir):
    width = len(spark.read.parquet(f"{sf_dir}/embeddings.parquet").first()["embedding"])
    found = entry.queries()["a12_whole_prototypes"](spark, sf_dir).groupBy("track_id", "space").count().collect()
    assert width > 8 and found and {r["count"] for r in found} == {width}
