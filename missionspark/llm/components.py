"""Connected components of an edge table, without bringing edges together.

The alternating large-star and small-star rounds of the MapReduce literature:
each round points every node at a smaller neighbour, and the edges end as one
star for each component.  Minima are aggregated before the shuffle and written
first, so that a hub with many neighbours is a skewed join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise, new_path


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Rows (u, v), v a neighbour of u; large: the larger v go to u's minimum."""
    least = materialise(pairs.groupBy(F.col("u").alias("at")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-least")
    joined = pairs.join(least, F.col("u") == F.col("at"))
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v) of one ordered type to rows (node, root), root the least node reachable.

    Nodes without an edge to another node are not returned.  Loops and repeated
    edges do no harm; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, path = None, new_path(spark, "edges")
    pairs.write.parquet(path)
    schema = pairs.schema
    for _ in range(rounds):
        pairs = spark.read.schema(schema).parquet(path)
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, old = state, path
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        path = new_path(spark, "edges")
        _star(_star(both, True), False).write.parquet(path)
        discard(spark, old)
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
