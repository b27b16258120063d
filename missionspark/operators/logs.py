"""Append-only logs, versions, deduplication and set operators."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.exprs import cosine
from ..sources import commits
from ..sources.storage import discard, materialise, release, small


def materialise_graph(deltas: DataFrame) -> DataFrame:
    """The current view of a log of deltas: those superseded and ends are out.

    (delta_id, superseded, ...): superseded nodes are kept apart by the flag.
    """
    gone = deltas.filter("supersedes is not null").select(F.col("supersedes").alias("gone")).distinct()
    met = deltas.join(gone, F.col("edge_id") == F.col("gone"), "left")
    return met.withColumn("superseded", F.col("gone").isNotNull()).drop("gone").filter("not superseded and op <> 'end'")


def _doubled(ends: DataFrame) -> DataFrame:
    """Pointers (node, last) each moved on to where their target points; those that point at an end stay."""
    far = ends.select(F.col("node").alias("via"), F.col("last").alias("further"))
    return ends.join(far, F.col("last") == F.col("via"), "left").select("node", F.coalesce("further", "last").alias("last"))


def effective_status(proposals: DataFrame) -> DataFrame:
    """The status at the end of each proposal's chain of replacements.

    Of several replacements the last one counts.  Pointers are doubled until none
    moves, so a chain of n needs log2(n) rounds; a chain that runs into a cycle
    has no end and no status.
    """
    child = proposals.filter("supersedes is not null").groupBy(F.col("supersedes").alias("parent")).agg(F.max("proposal_id").alias("child"))
    ends = materialise(proposals.select("proposal_id").join(child, F.col("proposal_id") == F.col("parent")).select(F.col("proposal_id").alias("node"), F.col("child").alias("last")), "status-chain")
    rounds = max(1, ends.count()).bit_length() + 1
    for _ in range(rounds):
        step = materialise(_doubled(ends), "status-chain")
        moved = ends.select("node", F.col("last").alias("was")).join(step, "node").filter("was <> last").isEmpty()
        release(ends)
        ends = step
        if moved:
            break
    # After more than the chain's length of steps a pointer that still points at a node with a child runs in a cycle.
    status = proposals.select(F.col("proposal_id").alias("of"), "status")
    inner = ends.select(F.col("node").alias("inner"))
    found = proposals.select("proposal_id").join(ends, F.col("proposal_id") == F.col("node"), "left").withColumn("last", F.coalesce("last", "proposal_id")).join(inner, F.col("last") == F.col("inner"), "left")
    found = found.withColumn("last", F.when(F.col("inner").isNull(), F.col("last"))).join(status, F.col("last") == F.col("of"), "left")
    return found.select("proposal_id", F.col("last").alias("effective_id"), F.col("status").alias("effective_status"))


def check_cycles(pairs: DataFrame) -> DataFrame:
    """Nodes of (child, parent) pairs that come back to themselves.

    Pointers that end are dropped while the others are doubled.  When a round
    drops none, all that is left leads into a cycle; when it points at no fewer
    nodes either, these are the cycles' own: a step that maps them onto
    themselves can't leave one out that is in a cycle or hold one that is not.
    """
    at = materialise(pairs.filter("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("last")).distinct(), "cycles")
    sizes = lambda table, column: table.select(column).distinct().count()
    rows, image = at.count(), None
    single = sizes(at, "node") == rows  # rows then are nodes; a child with several parents takes all rounds
    for _ in range(max(1, rows).bit_length()):
        far = at.select(F.col("node").alias("via"), F.col("last").alias("further"))
        step = materialise(at.join(far, F.col("last") == F.col("via")).select("node", F.col("further").alias("last")), "cycles")
        was, rows = rows, step.count()
        release(at)
        at = step
        if single and rows == was:
            before, image = image, sizes(at, "last")
            if image == before:
                break
        if not rows:
            break
    return at.select(F.col("last").alias("node")).distinct()


#: Ids that one task counts, about; a table of more is dealt to more tasks.
TASK_IDS = 1_000_000


def check_unique(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Ids that occur more than once: (kind, id, n)."""
    return repeated_ids([(df, {kind: F.col(column).cast("string")}) for kind, (df, column) in tables.items()])


def repeated_ids(tables: Sequence[tuple[DataFrame, dict[str, Column]]], n_ids: int | None = None) -> DataFrame:
    """(kind, id, n) of the ids that occur more than once in a kind.

    Each table is read once, whatever kinds its ids have.  Nearly all ids differ, so none
    are counted before they are dealt, and the number of tasks follows that of the ids
    (``n_ids`` where a bound is known, else counted).
    """
    kinds = list(dict.fromkeys(kind for _, ids in tables for kind in ids))
    parts = [df.select(F.explode(F.array(*[F.struct(F.lit(kinds.index(kind)).alias("place"), c.alias("id")) for kind, c in ids.items()])).alias("i")).select("i.*") for df, ids in tables]
    rows = functools.reduce(DataFrame.unionByName, parts)
    context = rows.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-(rows.count() if n_ids is None else n_ids) // TASK_IDS))
    each = rows.repartition(tasks, "place", "id").groupBy("place", "id").agg(F.count("*").alias("n")).filter("n > 1")
    return each.select(F.get(F.array(*map(F.lit, kinds)), F.col("place")).alias("kind"), "id", "n")


def diff_ids(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Ids that one side alone has: (id, side)."""
    left, right = a.select(F.col(column).alias("id")), b.select(F.col(column).alias("id"))
    return left.exceptAll(right).distinct().withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).distinct().withColumn("side", F.lit("right")))


def union_kinds(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several kinds in one table; missing columns are null."""
    found = None
    for kind, df in parts.items():
        rows = df.withColumn("event_kind", F.lit(kind))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def dedupe_files(files: DataFrame, processed: DataFrame, content: str) -> DataFrame:
    """Files whose digest is neither processed nor met before: the least id of each digest."""
    rows = files.withColumn("digest", F.sha2(F.col(content), 256))
    first = rows.groupBy("digest").agg(F.min("file_id").alias("file_id"), F.count("*").alias("copies"))
    return first.join(processed.select("digest").distinct(), "digest", "left_anti")


#: Hashes of one key and band that are compared with each other; of more, those alike in a second band are.
BUCKET_ROWS = 2_000


def bands(radius: int, bits: Sequence[int]) -> list[list[int]]:
    """So many parts of the bits that hashes within the radius agree in one of them."""
    edges = [round(len(bits) * k / (radius + 1)) for k in range(radius + 2)]
    return [list(bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def hamming_pairs(tiles: DataFrame, radius: int, bits: int = 64, keys: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs of hashes of so many bits within a Hamming radius: (keys, a, b, distance), a before b.

    Only hashes of equal keys meet.  Of radius + 1 bands one is equal in every
    such pair.  In a band of more rows than ``bucket_rows`` the other bits are cut
    in bands again, of which one is equal too: so a frequent part makes pairs of
    hashes that are alike in more than it.
    """
    def part(own: Sequence[int]) -> Column:
        lo, n = (own[0], len(own)) if own else (0, 0)
        return F.shiftrightunsigned("hash", lo).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1))

    cut = bands(radius, range(bits))
    band = F.array(*[F.struct(F.lit(k).alias("band"), part(own).alias("part")) for k, own in enumerate(cut)])
    rows = tiles.select(*keys, "tile_id", "hash", F.explode(band).alias("b")).select(*keys, "tile_id", "hash", "b.*")
    crowd = materialise(rows.groupBy(*keys, "band", "part").agg(F.count("*").alias("rows")).filter(F.col("rows") > bucket_rows), "tiles-crowds")
    # The bits before and after a band, each a run of bits, cut to second bands.
    second = []
    for k, own in enumerate(cut):
        rest = [[i for i in range(bits) if i < own[0]], [i for i in range(bits) if i > own[-1]]] if own else [list(range(bits)), []]
        pieces, left = [], radius + 1
        for run in rest:
            n = round((radius + 1) * len(run) / max(1, bits - len(own))) if run is rest[0] else left
            n = min(max(n, 0), left)
            pieces += bands(n - 1, run) if n > 0 else []
            left -= n
        second.append(F.when(F.col("band") == k, F.array(*[F.struct(F.lit(j).alias("band2"), part(p).alias("part2")) for j, p in enumerate(pieces)])))
    on = [*keys, "band", "part"]
    calm = rows.join(crowd, on, "left_anti").withColumn("band2", F.lit(-1)).withColumn("part2", F.lit(0).cast("long"))
    busy = rows.join(crowd, on, "left_semi").withColumn("c", F.explode(F.coalesce(*second))).select(*on, "tile_id", "hash", F.col("c.band2").alias("band2"), F.col("c.part2").cast("long").alias("part2"))
    dealt = calm.select(*on, "tile_id", "hash", "band2", "part2").unionByName(busy)
    on = [*on, "band2", "part2"]
    other = dealt.select(*[F.col(c).alias(f"o_{c}") for c in (*on, "tile_id", "hash")])
    off = F.bit_count(F.col("hash").bitwiseXOR(F.col("o_hash")))
    met = dealt.join(other, [*[F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in on], F.col("tile_id") < F.col("o_tile_id"), off <= radius])
    return met.select(*keys, F.col("tile_id").alias("a"), F.col("o_tile_id").alias("b"), off.alias("distance")).distinct()


def dedupe_tiles(tiles: DataFrame, radius: int = 6, least_cosine: float = 0.95, most: int = 200, bits: int = 64) -> DataFrame:
    """Tiles that no earlier tile of their mission resembles, the best of each cell and window.

    A tile goes if an earlier one (a lesser id) has a hash within the radius and a
    vector as alike; tiles of one hash and one vector are one, the least id, before
    pairs are formed.  Of the others the best score of a (mission, cell, window)
    stays, at most ``most`` of a mission.
    """
    same = ["mission_id", "hash", "vector"]
    first = tiles.groupBy(*same).agg(F.min_by(F.struct(*[c for c in tiles.columns if c not in same]), "tile_id").alias("t")).select(*same, "t.*")
    near = hamming_pairs(first, radius, bits, ["mission_id"]).drop("mission_id")
    v = first.select(F.col("tile_id").alias("va"), F.col("mission_id").alias("ma"), F.col("vector").alias("xa"))
    w = first.select(F.col("tile_id").alias("vb"), F.col("mission_id").alias("mb"), F.col("vector").alias("xb"))
    alike = near.join(v, F.col("a") == F.col("va")).join(w, F.col("b") == F.col("vb")).filter((F.col("ma") == F.col("mb")) & (cosine(F.col("xa"), F.col("xb")) > least_cosine))
    left = first.join(alike.select(F.col("b").alias("gone")).distinct(), F.col("tile_id") == F.col("gone"), "left_anti")
    best = left.groupBy("mission_id", "cell", "window").agg(F.max_by(F.struct("tile_id", "score"), F.struct("score", -F.col("tile_id"))).alias("t")).select("mission_id", "cell", "window", "t.*")
    place = F.row_number().over(Window.partitionBy("mission_id").orderBy(F.desc("score"), "tile_id"))
    return best.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def check_identity(rows: DataFrame, runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that disagree with their run in a named column: (mission_id, code, n)."""
    named = runs.select(F.col("mission_id").alias("run_mission"), *[F.col(c).alias(f"run_{c}") for c in columns])
    met = rows.join(named, F.col("mission_id") == F.col("run_mission"), "left")
    codes = F.array(F.when(F.col("run_mission").isNull(), F.lit("unknown_mission")), *[F.when(F.col(c) != F.col(f"run_{c}"), F.lit(f"other_{c}")) for c in columns])
    return met.select("mission_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")).groupBy("mission_id", "code").agg(F.count("*").alias("n"))


# --- tables on disk ---


def append_log(df: DataFrame, path: str, id_column: str) -> None:
    """Appends rows to a Parquet log; an id that is there already, or twice in the rows, is refused."""
    spark = df.sparkSession
    twice = df.groupBy(id_column).count().filter("count > 1").limit(1).count()
    try:
        known = spark.read.parquet(path).select(id_column)
    except AnalysisException as error:  # the first append makes the log
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if twice or known is not None and df.join(known, id_column, "left_semi").limit(1).count():
        raise ValueError(f"a repeated {id_column} is refused")
    df.write.mode("append").parquet(path)


def latest_wins(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert as a table: the new row of a key replaces the current one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("row")).select(*keys, "row.*")


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Replaces the partitions that the rows touch and leaves the others."""
    df.write.partitionBy(column).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def replace_run(tables: dict[str, DataFrame], folder: str, run_column: str = "run_id") -> str:
    """Run, events, edges and QA of the runs in ``tables['run']`` replace what is stored of these runs.

    The rows are appended under the name of this attempt, and so are the runs that
    it replaces; one commit then switches all tables at once.  Until it is there
    :func:`read_runs` gives the old rows of every table, also when the attempt was
    cut short, and of two attempts at a time one is refused.  A run that another
    stored run supersedes can't be replaced, as results point at it.  Returns the
    attempt.
    """
    run = tables["run"]
    spark = run.sparkSession
    ids = run.select(run_column).distinct()
    known = commits.numbers(spark, folder)
    if known:
        stored = read_runs(spark, folder, "run", run_column)
        pointed = stored.filter("supersedes_run_id is not null").select(F.col("supersedes_run_id").alias("pointed"), F.col(run_column).alias("by"))
        own = ids.select(F.col(run_column).alias("own"))
        if not pointed.join(ids, F.col("pointed") == F.col(run_column)).join(own, F.col("by") == F.col("own"), "left_anti").isEmpty():
            raise ValueError("a run that a later run supersedes can't be replaced")
    for kind, df in tables.items():
        if not df.join(ids, run_column, "left_anti").isEmpty():
            raise ValueError(f"{kind} has rows of another run")
    attempt = uuid.uuid4().hex
    stage_run(tables, folder, attempt, run_column)
    commits.publish(spark, folder, {"attempt": attempt, "schemas": {kind: df.schema.json() for kind, df in tables.items()}}, after=known[-1] if known else 0)
    return attempt


def stage_run(tables: dict[str, DataFrame], folder: str, attempt: str, run_column: str = "run_id") -> None:
    """Writes an attempt's rows, which nobody sees before its commit."""
    for kind, df in tables.items():
        df.withColumn("attempt", F.lit(attempt)).write.partitionBy("attempt").mode("append").parquet(f"{folder}/{kind}")
    tables["run"].select(run_column).distinct().withColumn("attempt", F.lit(attempt)).write.partitionBy("attempt").mode("append").parquet(f"{folder}/switches")


def current_runs(spark: SparkSession, folder: str, run_column: str = "run_id") -> DataFrame:
    """(run, attempt): the attempt of the last commit that replaced a run."""
    log = spark.read.schema("attempt string").json(f"{folder}/commits/*.json").select(F.col("attempt").alias("by"), F.col("_metadata.file_name").alias("number"))
    switches = spark.read.parquet(f"{folder}/switches").select(run_column, F.col("attempt").cast("string").alias("attempt"))
    return switches.join(log, F.col("attempt") == F.col("by")).groupBy(run_column).agg(F.max_by("attempt", "number").alias("attempt"))


def read_runs(spark: SparkSession, folder: str, kind: str, run_column: str = "run_id") -> DataFrame:
    """The stored rows of a kind, each run as its last commit left it."""
    schema = StructType.fromJson(json.loads(commits.committed(spark, folder)["schemas"][kind]))
    rows = spark.read.schema(StructType([*schema.fields, StructField("attempt", StringType())])).parquet(f"{folder}/{kind}")
    return rows.join(current_runs(spark, folder, run_column), [run_column, "attempt"], "left_semi").select(*schema.names)


def vacuum_runs(spark: SparkSession, folder: str, kinds: Sequence[str], run_column: str = "run_id") -> None:
    """Deletes attempts that no run is left with, unfinished ones too; not while a writer is at work."""
    live = {r.attempt for r in current_runs(spark, folder, run_column).select("attempt").distinct().toLocalIterator()}
    for kind in kinds:
        for name in commits.folders(spark, f"{folder}/{kind}"):
            if name.startswith("attempt=") and name[8:] not in live:
                discard(spark, f"{folder}/{kind}/{name}")


def run_tables(manifests: DataFrame, events: DataFrame, edges: DataFrame, qa: DataFrame) -> dict[str, DataFrame]:
    """Query rows of mission bundles, for :func:`replace_run`: run, events, edges and qa under the digest of the manifest.

    ``manifests`` has (mission_id, manifest, artifact_dir), the manifest as it is
    stored, with profile, schema_version, coordinate_frame (name, metric_scale,
    calibration_id), degradations and supersedes_sha256; ``events`` an array
    ``evidence``, of which the number is kept.  Rows of missions without a
    manifest have no run and are left out.
    """
    field = lambda path: F.get_json_object("manifest", f"$.{path}")
    run_id = F.sha2("manifest", 256).alias("run_id")
    run = manifests.select(
        run_id, "mission_id", field("profile").alias("profile"), field("schema_version").alias("schema_version"), field("coordinate_frame.name").alias("coordinate_frame"), field("coordinate_frame.metric_scale").alias("metric_scale"),
        field("coordinate_frame.calibration_id").alias("calibration_id"), "artifact_dir", F.concat(F.lit("sha256:"), F.sha2("manifest", 256)).alias("manifest_sha256"), field("degradations").alias("degradations"),
        F.regexp_replace(field("supersedes_sha256"), "^sha256:", "").alias("supersedes_run_id"),
    )
    of = manifests.select(F.col("mission_id").alias("of"), run_id)
    under = lambda rows, ref: rows.join(of, F.col("mission_id") == F.col("of")).drop("of").withColumn("artifact_ref", F.lit(ref))
    told = under(events, "timeline.json").withColumn("evidence_count", F.coalesce(F.size("evidence"), F.lit(0))).drop("evidence")
    return {"run": run, "events": told, "edges": under(edges, "graph-deltas.jsonl"), "qa": under(qa, "qa.jsonl")}


def supersede(versions: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with their version, refused rows): a new document names the current digest.

    ``versions`` has (key, version, digest); new rows have (key, digest, supersedes_digest).
    """
    current = versions.groupBy(F.col(key).alias("of")).agg(F.max_by("digest", "version").alias("current"), F.max("version").alias("at"))
    met = new.join(current, F.col(key) == F.col("of"), "left")
    fits = F.when(F.col("of").isNull(), F.col("supersedes_digest").isNull()).otherwise(F.coalesce(F.col("supersedes_digest") == F.col("current"), F.lit(False)))
    met = met.withColumn("fits", fits).withColumn("version", F.coalesce("at", F.lit(0)) + 1)
    return met.filter("fits").select(*new.columns, "version"), met.filter("not fits").select(*new.columns)


def history(versions: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """All versions of all documents after new ones were accepted, the latest of each flagged as current."""
    both = versions.select(key, "version", "digest").unionByName(accepted.select(key, F.col("version").cast(versions.schema["version"].dataType), "digest"))
    last = both.groupBy(F.col(key).alias("of")).agg(F.max("version").alias("last"))
    return both.join(last, F.col(key) == F.col("of")).withColumn("current", F.col("version") == F.col("last")).drop("of", "last")


def unpublished(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Accepted events with evidence that the ledger doesn't know, each once."""
    from .filters import publishable

    known = ledger.select(F.col("event_id").alias("known"))
    return publishable(events).join(known, F.col("event_id") == F.col("known"), "left_anti").dropDuplicates(["event_id"])


def envelopes(events: DataFrame, zone_id: str, sensor_id: str, published_at: Column) -> DataFrame:
    """Events in the envelope of the bus: (event_id, ts, zone_id, sensor_id, confidence, payload, artifact_uri)."""
    payload = F.to_json(F.struct("event_id", "mission_id", F.col("type").alias("event_type"), "start_sec", "end_sec", "participant", "confidence", F.lit("accepted").alias("verification_status"), F.lit("timeline.json").alias("artifact_uri")))
    return events.select("event_id", published_at.alias("ts"), F.lit(zone_id).alias("zone_id"), F.lit(sensor_id).alias("sensor_id"), "confidence", payload.alias("payload"), F.lit("timeline.json").alias("artifact_uri"))


def publish(events: DataFrame, path: str, zone_id: str, sensor_id: str, published_at: Column) -> DataFrame:
    """Appends the envelopes of events that the ledger at ``path`` doesn't have; returns what was appended.

    Run again, also on a stream's repeated batch, it appends nothing.
    """
    spark = events.sparkSession
    try:
        ledger = spark.read.parquet(path).select("event_id")
    except AnalysisException as error:  # the first publication makes the ledger
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = spark.createDataFrame([], events.select("event_id").schema)
    new = materialise(envelopes(unpublished(events, ledger), zone_id, sensor_id, published_at), "published")
    new.write.mode("append").parquet(path)
    return new


def write_replay(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Writes a replay log as JSON lines in one order over all files."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)


def export_vectors(points: DataFrame, missions: Sequence | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Frames with a vector for a cache; missing places become NaN."""
    rows = points.filter("type = 'frame' and embedding is not null")
    if missions is not None:
        rows = rows.filter(F.col("mission_id").isin(list(missions)))
    if bbox:
        rows = rows.filter(F.col("lat").between(bbox[0], bbox[1]) & F.col("lon").between(bbox[2], bbox[3]))
    nan = F.lit(float("nan"))
    return rows.select("id", "mission_id", "t_sec", *[F.coalesce(c, nan).alias(c) for c in ("lat", "lon", "tx", "ty", "tz")], "embedding")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line) of text files, which are read in splits.

    A split's rows are numbered where they are read; what a split's first line is
    follows from the numbers of lines of the splits before it, so a huge file is
    many tasks and none has all of its lines.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    splits = text.groupBy(F.col("file").alias("of"), F.col("start").alias("at")).agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = materialise(splits.withColumn("before", before).drop("lines"), "log-splits")
    met = text.join(small(splits), (F.col("file") == F.col("of")) & (F.col("start") == F.col("at")))
    return met.select("value", "file", (F.col("before") + F.col("n") - F.col("first") + 1).alias("line"))


def read_log(spark: SparkSession, path: str, schema: str, allowed: Sequence[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of JSON lines, fail-closed: a bad line is an issue with its file and line.

    A line must be an object of the schema with known fields and this version.
    """
    text = numbered_lines(spark, path)
    parsed = text.withColumn("row", F.from_json("value", f"{schema}, schema_version string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    keys = F.json_object_keys("value")
    code = F.coalesce(
        F.when(keys.isNull() | F.col("row._bad").isNotNull(), F.lit("not_an_object")),
        F.when(F.size(F.array_except(keys, F.array(*map(F.lit, [*allowed, "schema_version"])))) > 0, F.lit("unknown_field")),
        F.when(F.coalesce(F.col("row.schema_version") != version, F.lit(True)), F.lit("wrong_version")),
    )
    parsed = parsed.withColumn("code", code)
    return parsed.filter("code is null").select("file", "line", *[F.col(f"row.{c}") for c in allowed]), parsed.filter("code is not null").select("file", "line", "code")


def read_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Documents of a folder tree, one row a file; ``doc`` is null where it isn't the schema."""
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root)
    return files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("doc"))


def audit_artifacts(manifests: DataFrame, stored: DataFrame, required: Sequence[str]) -> DataFrame:
    """Issues of manifest entries (mission_id, kind, path, digest, size) against stored files (path, digest, size)."""
    known = stored.select(F.col("path").alias("stored_path"), F.col("digest").alias("stored_digest"), F.col("size").alias("stored_size"))
    met = manifests.join(known, F.col("path") == F.col("stored_path"), "left")
    code = F.coalesce(
        F.when(F.col("path").startswith("/") | F.col("path").contains(".."), F.lit("escaping_path")), F.when(F.col("stored_path").isNull(), F.lit("missing")),
        F.when((F.col("digest") != F.col("stored_digest")) | (F.col("size") != F.col("stored_size")), F.lit("mismatch")),
    )
    issues = met.withColumn("code", code).filter("code is not null").select("mission_id", "kind", "path", "code")
    kinds = manifests.groupBy("mission_id", "kind").agg(F.count("*").alias("n"))
    wanted = manifests.select("mission_id").distinct().select("mission_id", F.explode(F.array(*map(F.lit, required))).alias("kind"))
    absent = wanted.join(kinds, ["mission_id", "kind"], "left").filter("coalesce(n, 0) <> 1").select("mission_id", "kind", F.lit(None).cast("string").alias("path"), F.lit("required_once").alias("code"))
    return issues.unionByName(absent)


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, digest, size) of stored files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace(F.substring_index("path", root.rstrip("/"), -1), "^/", "").alias("path"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))


def bundle_inventory(lines: DataFrame) -> DataFrame:
    """Rows, time span and first fix of each sidecar (file, value): times in ``t``, else ``timestamp``."""
    t = F.coalesce(F.get_json_object("value", "$.t"), F.get_json_object("value", "$.timestamp")).cast("double")
    fix = F.struct(F.get_json_object("value", "$.lat").cast("double").alias("lat"), F.get_json_object("value", "$.lon").cast("double").alias("lon"))
    rows = lines.filter("trim(value) <> ''").withColumn("t", t).withColumn("fix", F.when(fix["lat"].isNotNull() & fix["lon"].isNotNull(), fix))
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("t").alias("t_start_sec"), F.max("t").alias("t_end_sec"), F.min_by("fix", F.when(F.col("fix").isNotNull(), F.col("t"))).alias("origin"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a recorded trace as variants; blank lines and other values are skipped."""
    parsed = spark.read.text(path).withColumn("v", F.try_parse_json("value"))
    return parsed.filter(F.col("v").isNotNull() & F.col("value").rlike(r"^\s*\{")).select("value", "v")
