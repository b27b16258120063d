"""A training corpus from raw documents, in five stages.

Each stage takes the documents that its predecessor kept and all but the last
return documents with their own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from missionspark.llm import exact_dedup, mixing, sentencepiece_codec, simhash, toxicity
from missionspark.llm.storage import materialise

#: Rows that go to Python at once: a batch of texts lies whole in the executor and in its Python process.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Sets the rows of a batch in the pipeline's session, whose rows are whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    lean(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    lean(spark)
    return simhash.representatives(docs, words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of each document."""
    lean(spark)
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load())


STAGES = [("toxicity", toxic_out), ("exact dedup", exact_once), ("simhash near-dedup", near_once), ("mixing", mixed), ("sentencepiece", encoded)]
#: SQL can't express the toxicity, near-dedup and encoding stages; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
