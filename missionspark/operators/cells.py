"""Vector search by cells: points near each other in direction are searched together.

Centres are fitted on a bounded sample; every point is indexed under its nearest
one.  A cell's widest angle bounds the cosine of a query with any of its points:
``cos(max(0, angle(query, centre) - widest))``.  A search looks into the cells
whose centres are nearest to a query (the approximate way), and, to be exact, then
into those others whose bound reaches the query's k-th score.

Cells are packed into blocks of bounded size, and a query goes once to a block,
however many of its cells it looks into.  A cell with a third of all points, or
one that all queries ask for, is many tasks: blocks and the queries that look
into them are cut in slices.  In a task the queries go by a few hundred at a time:
products in single precision leave what can reach the k-th score, and only that is
worked out in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import materialise, release

#: Points that centres are fitted on, points of a cell about, cells at most.
SAMPLE, CELL_POINTS, MOST_CELLS = 50_000, 256, 1024
#: Points and queries that meet in one task, queries that are compared at once.
POINT_SLICE, QUERY_SLICE, TILE = 32_768, 32_768, 256
#: Rows of vectors that a batch holds at most, and what products in single precision may be off.
BATCH, SLACK = 8_192, 1e-5
FOUND = "query_id long, id long, score double"


def unit(vectors) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    v = np.stack([np.asarray(x, np.float64) for x in vectors]) if len(vectors) else np.zeros((0, 1))
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1.0)


def fitted(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centres of a sample by directions."""
    rng = np.random.default_rng(9)
    centre = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = (sample @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1.0), centre)
    return centre


@dataclass
class Index:
    """Points (id, v, cell) in a written table; centre, widest angle and number of points of each cell."""

    points: DataFrame
    centre: np.ndarray
    widest: np.ndarray
    count: np.ndarray


def build(points: DataFrame, vector: str = "embedding", cells: int | None = None) -> Index | None:
    """Indexes all points (id, vector); those without a vector are left out.  None without a point."""
    rows = points.filter(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("id"), narrow(points, vector).alias("v"))
    n = rows.count()
    if not n:
        return None
    sample = unit([r.v for r in rows.orderBy(F.xxhash64(F.lit(3), "id")).limit(SAMPLE).select("v").collect()])
    centre = fitted(sample, min(len(sample), cells or max(1, min(MOST_CELLS, n // CELL_POINTS))))
    shared = points.sparkSession.sparkContext.broadcast(centre)

    def assign(batches):
        for b in batches:
            near = unit(b.column(1).to_pylist()) @ shared.value.T
            cell = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])], ["id", "v", "cell", "near"])

    table = materialise(rows.mapInArrow(assign, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])), "cells")
    widest, count = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
    for r in table.groupBy("cell").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect():  # a row a cell
        widest[r.cell], count[r.cell] = np.arccos(np.clip(r.near, -1, 1)) + 1e-6, r.n
    return Index(table, centre, widest, count)


def probed(index_: tuple, near: np.ndarray, probes: int, k: int) -> np.ndarray:
    """Which cells each query looks into first: the nearest ones, as many as hold more than k points together."""
    count = index_[2]
    order = np.argsort(-near, axis=1, kind="stable")
    held = np.cumsum(count[order], axis=1) - count[order]
    look = (np.arange(near.shape[1])[None, :] < probes) | (held <= k)
    found = np.zeros(near.shape, bool)
    np.put_along_axis(found, order, look, axis=1)
    return found & (count > 0)[None, :]


def narrow(points: DataFrame, vector: str) -> Column:
    """The vector as it is given if in single precision, else in double."""
    kind = points.schema[vector].dataType
    return F.col(vector) if kind == T.ArrayType(T.FloatType(), kind.containsNull) else F.col(vector).cast("array<double>")


def best_of(at: np.ndarray, queries, least: np.ndarray, ids: np.ndarray, points, k: int) -> pd.DataFrame:
    """The k best of the points for each query among those that reach its ``least`` score: scores to nine digits, equal ones by id."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    if not len(at) or not len(ids):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
    order = np.argsort(ids, kind="stable")
    ids, x, y = ids[order], unit(points)[order], unit(queries)
    x32, rows = np.ascontiguousarray(x.T.astype(np.float32)), []
    for first in range(0, len(at), TILE):
        near = y[first : first + TILE].astype(np.float32) @ x32
        low = least[first : first + TILE]
        if len(ids) > k + 1 and (low < -1).any():  # nothing known: the k-th best here, and one more, as a point may be the query itself
            low = np.maximum(low, np.partition(near, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1])
        reach = near >= (low - SLACK)[:, None]
        for i in np.flatnonzero(reach.any(axis=1)):
            found = np.flatnonzero(reach[i])
            found = found[ids[found] != at[first + i]]
            score = np.round(x[found] @ y[first + i], 9)
            top = np.argsort(-score, kind="stable")[:k]
            rows.append((np.full(len(top), at[first + i]), ids[found[top]], score[top]))
    return pd.DataFrame({n: np.concatenate(c) if c else np.zeros(0, np.int64) for n, c in zip(names, zip(*rows) if rows else ((), (), ()))})


def packed(count: np.ndarray) -> np.ndarray:
    """The block of each cell: neighbours in number share one until it holds a slice of points."""
    return ((np.cumsum(count) - count) // POINT_SLICE).astype(np.int32)


def routed(index: Index, queries: DataFrame, k: int, probes: int, beyond: bool) -> DataFrame:
    """(query_id, v, least, cell): where each query looks first, or the blocks ``beyond`` that where its ``least`` score may be reached."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centre, index.widest, index.count, packed(index.count)))
    queries = queries if "least" in queries.columns else queries.withColumn("least", F.lit(-2.0))

    def route(batches):
        centre, widest, count, block = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                near = np.clip(unit(b.column(1).to_pylist()) @ centre.T, -1, 1)
                look = probed(shared.value, near, probes, k)
                if beyond:
                    bound = np.cos(np.maximum(0.0, np.arccos(near) - widest[None, :])) + 1e-6
                    look = ~look & (count > 0)[None, :] & (bound >= b.column(2).to_numpy(zero_copy_only=False)[:, None])
                    look = np.stack([look[:, block == c].any(axis=1) for c in range(block[-1] + 1)], axis=1)
                row, cell = np.nonzero(look)
                for at in range(0, len(row), BATCH):
                    some = pa.array(row[at : at + BATCH])
                    yield pa.RecordBatch.from_arrays([b.column(c).take(some) for c in range(3)] + [pa.array(cell[at : at + BATCH].astype(np.int32))], ["query_id", "v", "least", "cell"])

    return queries.mapInArrow(route, T.StructType([*queries.schema, T.StructField("cell", T.IntegerType())]))


def scored(index: Index, pairs: DataFrame, k: int, blocks: bool) -> DataFrame:
    """The k best points of each query among the cells, or the ``blocks`` of cells, it looks into, for each pair of slices."""
    spark = pairs.sparkSession
    asked = {r.cell: r["count"] for r in pairs.groupBy("cell").count().collect()}  # a row a cell
    block = packed(index.count)
    held = np.bincount(block, index.count) if blocks else index.count
    plan = [(c, -(-int(held[c]) * 4 // (POINT_SLICE * 5)), -(-n // QUERY_SLICE)) for c, n in asked.items()]
    if not plan:
        return spark.createDataFrame([], FOUND)
    slices = F.broadcast(spark.createDataFrame(plan, "of int, p_slices int, q_slices int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    points = index.points
    if blocks:
        of = F.broadcast(spark.createDataFrame([(c, int(n)) for c, n in enumerate(block)], "in int, block int"))
        points = points.join(of, F.col("cell") == F.col("in")).select("id", "v", F.col("block").alias("cell"))
    left = pairs.join(slices, F.col("cell") == F.col("of")).select("query_id", "v", "least", "cell", mine("query_id", "q_slices").alias("q"), every("p_slices").alias("p"))
    right = points.join(slices, F.col("cell") == F.col("of")).select("id", "v", "cell", mine("id", "p_slices").alias("p"), every("q_slices").alias("q"))

    def best(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        return best_of(queries["query_id"].to_numpy(np.int64), queries["v"], queries["least"].to_numpy(np.float64), points["id"].to_numpy(np.int64), points["v"], k)

    keys = ["cell", "p", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, FOUND)


def search(index: Index | None, queries: DataFrame, k: int, vector: str = "embedding", probes: int = 8, exact: bool = True) -> DataFrame:
    """The k nearest points of each query (id, vector) by cosine: (query_id, id, score, place).

    A point is not its own neighbour; equal scores, to nine digits, go by id.
    With ``exact`` the result is that of a scan; without, points outside the
    ``probes`` nearest cells are missed.
    """
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("query_id"), narrow(queries, vector).alias("v"))
    if index is None:
        return queries.sparkSession.createDataFrame([], f"{FOUND}, place int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = lambda df: df.withColumn("place", place).filter(F.col("place") <= k)
    pairs = materialise(routed(index, asked, k, probes, False), "cells-pairs")
    near = materialise(top(scored(index, pairs, k, False)), "cells-near")
    release(pairs)
    if not exact:
        return near
    least = near.filter(F.col("place") == k).select(F.col("query_id").alias("of"), F.col("score").alias("least"))
    again = asked.join(least, F.col("query_id") == F.col("of"), "left").select("query_id", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
    pairs = materialise(routed(index, again, k, probes, True), "cells-pairs")
    # A block also holds cells that were looked into before.
    both = near.drop("place").unionByName(scored(index, pairs, k, True))
    return top(both.groupBy("query_id", "id").agg(F.max("score").alias("score")))
