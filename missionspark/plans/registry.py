"""Registers queries over the domain tables beside their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.domain import domain, domain_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Domain tables by name, and given ones by ``raw``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return domain(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, tables: Sequence[str] = (), sql: str | None = None):
    """Registers a function of :class:`Tables` under a name; ``sql`` follows the tables' WITH clause.

    Further WITH entries go in ``sql`` itself, which then starts with a comma.
    """

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = (domain_sql(*tables) if tables else "") + sql
        return f

    return register
