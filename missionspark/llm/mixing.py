"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words.  The budget is a share of all
words; a source may give at most ``max_epochs`` times its own words.  The
water level ``v`` is the one number for which ``sum(min(cap, v * weight))``
equals the budget: sources above their cap are clamped and the excess goes to
the others by weight, until none is above.  Sorting the sources by
``cap / weight`` gives the level from two running sums, without iterating.

A target is then met by whole repetitions of every document plus a fractional
one.  Documents of a source are ordered by a seeded digest of their id; the
fractional repetition takes them in that order up to the remaining words, and
then the one further document that brings the sum nearest to the target.  The
cut in this order is found by refining digest prefixes (4,096 sums a level), so
a source with a third of all rows never meets in one task.

Defined cases: null text counts as empty and has size 0; a document of size 0
takes 0 words; a null source is a source of its own, last in order; rows that
repeat an id are taken or left together; an empty table gives an empty result;
columns of the input that share a name with the result's are replaced in the
decision table and left alone by :func:`mixture`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the digest that one refinement fixes, and how many it does.
DIGITS, LEVELS = 3, 2
#: Sources whose decisions are broadcast; with more, Spark joins by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(doc_id: Column, seed: int) -> Column:
    """Seeded place of a document in its source's order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight)."""
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("fill_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("fill_at", F.col("cap") / F.col("weight"))
        .withColumn("left_words", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level_here", F.col("left_words") / F.col("left_weight"))
        .withColumn("level", F.max(F.when(F.col("level_here") <= F.col("fill_at"), F.col("level_here"))).over(everything))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .drop("cap", "fill_at", "left_words", "left_weight", "level_here", "level")
    )


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def plan_sources(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """One row a source: target, whole repetitions, and where its fraction ends.

    ``sizes`` has (source, key, size).  Documents with a key below ``cut_key``
    are in the fractional repetition, and so is the one with ``extra_key``.
    """
    units = materialise(sizes.groupBy("source", "key").agg(F.sum("size").alias("size")), "mix-units")
    ranked = (
        units.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    )
    plan = (
        water_fill(ranked, share, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("prefix", F.lit(""))
        .withColumn("base", F.lit(0).cast("long"))
    )
    plan = materialise(plan, "mix-plan")
    for level in range(1, LEVELS + 2):
        part = F.col("key") if level > LEVELS else F.substring("key", 1, DIGITS * level)
        cut = plan.select(F.col("source").alias("in_source"), "rest", "prefix", "base")
        steps = (
            units.join(cut, units["source"].eqNullSafe(cut["in_source"]) & F.col("key").startswith(F.col("prefix")))
            .groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
            .withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("part")))
            .filter(F.col("upto") > F.col("rest"))
            .groupBy(F.col("source").alias("at_source"))
            .agg(F.min("part").alias("new_prefix"), F.min_by(F.col("upto") - F.col("words"), "part").alias("new_base"))
        )
        # A source without a step has no words; its cut stays before every key.
        plan = materialise(
            plan.join(steps, plan["source"].eqNullSafe(steps["at_source"]), "left")
            .withColumn("prefix", F.coalesce("new_prefix", "prefix"))
            .withColumn("base", F.coalesce("new_base", "base"))
            .drop("at_source", "new_prefix", "new_base"),
            "mix-plan",
        )
    plan = plan.withColumnsRenamed({"prefix": "cut_key", "base": "below"}).withColumn("missing", F.col("rest") - F.col("below"))
    cut = plan.select(F.col("source").alias("in_source"), "cut_key", "missing")
    nearest = (
        units.join(cut, units["source"].eqNullSafe(cut["in_source"]) & (F.col("key") >= F.col("cut_key")))
        .withColumn("off", F.abs(F.col("size") - F.col("missing")))
        .filter((F.col("size") > 0) & (F.col("off") < F.col("missing")))
        .groupBy(F.col("source").alias("at_source")).agg(F.min(F.struct("off", "key")).getField("key").alias("extra_key"))
    )
    return materialise(plan.join(nearest, plan["source"].eqNullSafe(nearest["at_source"]), "left").drop("at_source"), "mix-plan")


def decide(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(rows of doc_id, source, key, size; the plan of the sources)."""
    sizes = materialise(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")).withColumn("key", draw_key(F.col("doc_id"), seed)),
        "mix-sizes",
    )
    return sizes, plan_sources(sizes, weights, share, max_epochs)


def with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of (source, key, ...) with the number of times the mix takes each."""
    plan = plan.withColumnRenamed("source", "plan_source")
    plan = F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan
    sampled = (F.col("rest") > 0) & ((F.col("key") < F.col("cut_key")) | F.coalesce(F.col("key") == F.col("extra_key"), F.lit(False)))
    return rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"])).withColumn("repeats", F.col("whole").cast("int") + sampled.cast("int"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, repeats, taken."""
    sizes, plan = decide(docs, **options)
    return with_repeats(sizes, plan).select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixture(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it."""
    _, plan = decide(docs, doc_id=doc_id, text=text, source=source, seed=seed, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(source).alias("source"), draw_key(F.col(doc_id), seed).alias("key"))
    taken = with_repeats(keyed, plan).filter("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("nth")).select("row.*")
