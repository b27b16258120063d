"""Identity links: a new track is linked to the latest ended one of its label that looks alike.

Tracks of a label are never all compared with each other.  Vectors are dealt to
cells of direction, whose widest angle tells which cells can hold a vector of the
least cosine (one cell, where vectors have no directions to tell apart); in a cell the ended tracks are cut in blocks in order of their end,
and a birth looks backwards from the last block that it may be linked to, in
rounds that reach further each time, until what is left ended before its link.
So a birth with a recent link meets a few blocks, and one without any only the
cells that could hold it.  The result is that of a comparison with all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import dot
from ..sources.storage import materialise, release
from .cells import fitted, unit
from .joins import asof

#: Vectors that cells are fitted on, tracks of a cell about, cells at most.
SAMPLE, CELL_TRACKS, MOST_CELLS = 20_000, 256, 256
#: Share of the cells that a vector may reach on average.
MOST_REACHED = 0.25
#: Ended tracks of a block; each round looks at so many times more blocks than the last.
BLOCK, GROWTH = 64, 8
KEYS = ["mission_id", "label", "cell"]


def reached(near: np.ndarray, widest: np.ndarray, least_cosine: float) -> np.ndarray:
    """Which cells can hold a vector alike, by the cosines with their centres."""
    return np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - widest[None, :])) + 1e-6 >= least_cosine


def centres(sample: np.ndarray, tracks: int, least_cosine: float) -> np.ndarray:
    """Centres of the cells; a single one where a vector of the sample reaches more than ``MOST_REACHED`` of them, as cells then only add blocks to look at."""
    centre = fitted(sample, min(len(sample), max(1, min(MOST_CELLS, tracks // CELL_TRACKS))))
    near = sample @ centre.T
    cell, widest = near.argmax(axis=1), np.full(len(centre), -np.inf)
    np.maximum.at(widest, cell, np.arccos(np.clip(near.max(axis=1), -1, 1)))
    return centre if reached(near, widest, least_cosine).mean() <= MOST_REACHED else centre[:1]


def dealt(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """Rows (..., v) with their nearest ``cell`` and its cosine ``near``."""
    shared = rows.sparkSession.sparkContext.broadcast(centre)  # at most MOST_CELLS vectors
    names = rows.columns
    at = names.index("v")

    def assign(batches):
        for b in batches:
            near = unit(b.column(at).to_pylist()) @ shared.value.T if b.num_rows else np.zeros((0, len(shared.value)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.argmax(axis=1).astype(np.int32)), pa.array(near.max(axis=1, initial=-1.0))], [*names, "cell", "near"])

    return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())]))


def asked(rows: DataFrame, centre: np.ndarray, widest: np.ndarray, least_cosine: float) -> DataFrame:
    """Rows without their v, once for each ``cell`` that can hold one alike."""
    shared = rows.sparkSession.sparkContext.broadcast((centre, widest))
    names = [c for c in rows.columns if c != "v"]

    def ask(batches):
        centre, widest = shared.value
        for b in batches:
            near = unit(b.column("v").to_pylist()) @ centre.T if b.num_rows else np.zeros((0, len(centre)))
            look = reached(near, widest, least_cosine)
            cells = pa.ListArray.from_arrays(pa.array(np.r_[0, look.sum(axis=1).cumsum()].astype(np.int32)), pa.array(np.nonzero(look)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], cells], [*names, "cells"])

    kind = T.StructType([*rows.select(*names).schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(ask, kind).withColumn("cell", F.explode("cells")).drop("cells")


def link_identities(tracks: DataFrame, vectors: str, resets: DataFrame | None = None, least_cosine: float = 0.85, least_gap: float = 2.0, block: int = BLOCK) -> DataFrame:
    """Births linked to the latest ended track of their label that looks alike: (mission_id, track_id, linked, reason).

    ``tracks`` has (mission_id, track_id, label, born, ended, vector), an id once
    in a mission.  Between end and birth lie ``least_gap`` seconds (an occlusion),
    or a reset of the tracker (mission_id, t_sec) after the end and not after the
    birth (a cut).  Of ends at the same time the greatest id counts.  Tracks
    without a label, or with a vector that is null or all zeros, are not linked;
    one without an end is linked to others, and none to it.
    """
    rows = tracks.select("mission_id", "track_id", "label", "born", "ended", F.col(vectors).cast("array<double>").alias("v"))
    rows = rows.filter("label is not null and v is not null").filter(F.exists("v", lambda x: x != 0)).withColumn("last_reset", F.lit(None).cast("double"))
    if resets is not None:
        births = rows.select(F.struct("track_id").alias("query_id"), "mission_id", F.col("born").alias("t_sec"))
        last = asof(births, resets.select("mission_id", "t_sec", F.col("t_sec").alias("reset")), ["mission_id"], ["reset"], tolerance=0.0)
        last = last.select(F.col("query_id.track_id").alias("q"), F.col("mission_id").alias("q_m"), "reset")
        rows = rows.drop("last_reset").join(last, (F.col("track_id") == F.col("q")) & (F.col("mission_id") == F.col("q_m"))).withColumnRenamed("reset", "last_reset").drop("q", "q_m")
    rows = materialise(rows, "identity-tracks")
    sample = unit([r.v for r in rows.orderBy(F.xxhash64(F.lit(5), "mission_id", "track_id")).limit(SAMPLE).select("v").collect()])
    if not len(sample):
        return rows.select("mission_id", "track_id", F.col("track_id").alias("linked"), F.lit("").alias("reason"))
    centre = centres(sample, rows.count(), least_cosine)
    ended = materialise(dealt(rows.filter("ended is not null").select("mission_id", "track_id", "label", "ended", "v"), centre), "identity-cells")
    widest = np.full(len(centre), -np.inf)  # a cell without an ended track is asked by none
    for r in ended.groupBy("cell").agg(F.min("near").alias("near")).collect():  # a row a cell
        widest[r.cell] = np.arccos(np.clip(r.near, -1, 1)) + 1e-6
    # Places are told on narrow rows; vectors join them afterwards.
    order = Window.partitionBy(*KEYS).orderBy("ended", "track_id")
    placed = ended.select(*KEYS, "ended", "track_id").withColumn("p", F.row_number().over(order).cast("long") - 1)
    placed = materialise(placed, "identity-places")
    named = placed.select(F.col("mission_id").alias("n_m"), F.col("track_id").alias("n_t"), "p")
    o = ended.join(named, (F.col("mission_id") == F.col("n_m")) & (F.col("track_id") == F.col("n_t")))
    o = materialise(o.select(*[F.col(c).alias(f"o_{c}") for c in (*KEYS, "track_id", "ended", "v", "p")], F.floor(F.col("p") / block).alias("o_block")), "identity-ended")
    # What a birth may be linked to is the first so many of a cell's ended tracks; the margin is filtered where pairs meet.
    until = F.greatest(F.col("born") - least_gap + 1e-6, "last_reset")
    born = rows.filter("born is not null").select("mission_id", "track_id", "label", "born", "last_reset", "v")
    asks = asked(born, centre, widest, least_cosine)
    steps = placed.groupBy(*KEYS, "ended").agg(F.max("p").alias("p")).withColumnRenamed("ended", "t_sec")
    reach = asof(asks.select(F.struct("track_id").alias("query_id"), *KEYS, until.alias("t_sec")), steps, KEYS, ["p"], tolerance=0.0).filter("p is not null")
    todo = materialise(reach.select(*KEYS, F.col("query_id.track_id").alias("track_id"), F.col("p").alias("upto"), F.floor(F.col("p") / block).alias("top")), "identity-open")
    best, done, count = None, 0, 1
    while not todo.isEmpty():
        hits = looked(todo, born, o, done, count, least_cosine, least_gap)
        merged = hits if best is None else best.unionByName(hits)
        merged = materialise(merged.groupBy("mission_id", "track_id").agg(F.max("hit").alias("hit")), "identity-best")
        known = merged.select(F.col("mission_id").alias("b_m"), F.col("track_id").alias("b_t"), F.struct("hit.o_ended", "hit.o_track_id").alias("b_hit"))
        done, count = done + count, count * GROWTH
        on = (F.col("mission_id") == F.col("b_m")) & (F.col("track_id") == F.col("b_t"))
        # A cell stays open while the first end that was looked at is later than the link, or there is none.
        further = todo.filter(F.col("top") >= done).withColumn("lowest", (F.col("top") - done + 1) * block).join(known, on, "left")
        low = placed.select(*[F.col(c).alias(f"l_{c}") for c in (*KEYS, "p")], F.struct(F.col("ended").alias("o_ended"), F.col("track_id").alias("o_track_id")).alias("low"))
        further = further.join(low, [*[F.col(c) == F.col(f"l_{c}") for c in KEYS], F.col("lowest") == F.col("l_p")])
        later = materialise(further.filter(F.col("b_hit").isNull() | (F.col("b_hit") < F.col("low"))).select(*KEYS, "track_id", "upto", "top"), "identity-open")
        release(todo, *([] if best is None else [best]))
        todo, best = later, merged
    if best is None:
        return rows.limit(0).select("mission_id", "track_id", F.col("track_id").alias("linked"), F.lit("").alias("reason"))
    return best.select("mission_id", "track_id", F.col("hit.o_track_id").alias("linked"), F.when(F.col("hit.cut"), "camera_cut").otherwise("occlusion").alias("reason"))


def looked(todo: DataFrame, born: DataFrame, ended: DataFrame, done: int, count: int, least_cosine: float, least_gap: float) -> DataFrame:
    """A round: each open birth's latest link in the blocks looked at (mission_id, track_id, hit)."""
    a = born.select(F.col("mission_id").alias("a_m"), F.col("track_id").alias("a_t"), "born", "last_reset", "v")
    rows = todo.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("top") - (done + count - 1)), F.col("top") - done)))
    rows = rows.join(a, (F.col("mission_id") == F.col("a_m")) & (F.col("track_id") == F.col("a_t"))).drop("a_m", "a_t")
    met = rows.join(ended, [*[F.col(c) == F.col(f"o_{c}") for c in KEYS], F.col("at") == F.col("o_block"), F.col("o_p") <= F.col("upto")])
    cut = F.coalesce(F.col("last_reset") > F.col("o_ended"), F.lit(False))
    alike = dot(F.col("v"), F.col("o_v")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("o_v"), F.col("o_v")))) >= least_cosine
    ok = (F.col("track_id") != F.col("o_track_id")) & (F.col("o_ended") <= F.col("born")) & (cut | (F.col("born") - F.col("o_ended") >= least_gap))
    hits = met.filter(ok).filter(alike).select("mission_id", "track_id", F.struct("o_ended", "o_track_id", cut.alias("cut")).alias("hit"))
    return hits.groupBy("mission_id", "track_id").agg(F.max("hit").alias("hit"))
