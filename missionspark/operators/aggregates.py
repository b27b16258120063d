"""Grouped summaries of frames, sessions, missions and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise, release, small


def counts_by(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Counts of the named classes, 0 for those that don't occur."""
    named = df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    found = df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    return named.join(found, F.col(column) == F.col("class"), "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


#: Bins that a range of values is cut into by each pass.
BINS = 1024


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, which, value, n): the values at some ranks (from 1) of each key's n values that aren't null.

    ``ranks`` are columns of ``n``.  Each pass cuts the range that holds a rank into
    bins, counts them where the rows are and keeps the range of the bin that holds
    it, until the range is one value: three passes narrow it a thousand million
    times.  No task sorts or holds a key's values.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("which"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    state = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).withColumn("a", asked).select(*keys, "lo", "hi", "n", "a.*")
    state = materialise(state.withColumn("rank", F.greatest(F.lit(1), F.least("rank", "n"))), "ranks")
    while not state.filter("lo < hi").isEmpty():
        open_ = state.filter("lo < hi").withColumnsRenamed({k: f"s_{k}" for k in keys})
        met = rows.join(small(open_), [*[F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys], F.col("v").between(F.col("lo"), F.col("hi"))])
        # Halves, so that the range of any two doubles is finite.
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS))
        bins = met.withColumn("bin", bin_).groupBy(*keys, "which", "n", "rank", "bin").agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = bins.withColumn("upto", F.sum("m").over(Window.partitionBy(*keys, "which").orderBy("bin")))
        held = upto.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank"))).select(*keys, "lo", "hi", "n", "which", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))
        old, state = state, materialise(state.filter("lo >= hi").unionByName(held), "ranks")
        release(old)
    return state.select(*keys, "which", F.col("lo").alias("value"), "n")


def caption_health(frames: DataFrame) -> DataFrame:
    """One row: counts, null rate, mean and exact 95th percentile (between the two values around it) of the confidence.

    Frames skipped on purpose aren't captionable; without a captionable one the
    null rate is null.
    """
    skipped = F.col("caption_skip_reason").isNotNull()
    row = frames.agg(
        F.count("*").alias("total"), F.count("caption").alias("captioned"), F.count_if(skipped).alias("skipped"), F.count_if(F.col("caption").isNull() & ~skipped).alias("missing"), F.avg("caption_confidence").alias("mean_confidence"),
    )
    known = frames.filter("caption_confidence is not null").select(F.lit(0).alias("all"), F.col("caption_confidence").cast("double").alias("v"))
    # The two values around place 0.95 * (n - 1), counted from 0.
    place = 0.95 * (F.col("n") - 1)
    found = order_statistics(known, ["all"], "v", {"low": F.floor(place) + 1, "high": F.ceil(place) + 1})
    ends = found.agg(F.max(F.when(F.col("which") == "low", F.col("value"))).alias("low"), F.max(F.when(F.col("which") == "high", F.col("value"))).alias("high"), F.max(place - F.floor(place)).alias("part"))
    row = row.join(F.broadcast(ends)).withColumn("p95_confidence", F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).drop("low", "high", "part")  # one row each
    captionable = F.col("total") - F.col("skipped")
    return row.withColumn("null_rate", F.when(captionable > 0, F.col("missing") / captionable))


def model_breakdown(frames: DataFrame, most: int = 20) -> DataFrame:
    """Captions by model, the most frequent first."""
    return frames.filter("caption_model is not null").groupBy("caption_model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "caption_model").limit(most)


#: Annotations a week up to which their automation is told low and moderate, days before it is told, minutes that a reload saves.
LOW_A_WEEK, HIGH_A_WEEK, LEAST_DAYS, MINUTES_A_RELOAD = 0.5, 2.0, 7, 3


def annotation_roi(frames: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: annotations, their span and months, jobs that followed, weekly rate and a verdict.

    ``jobs`` has (type, status, progress as JSON).  An observed span is a day at
    least; below seven days the rate is null and the data insufficient.
    """
    done = frames.filter("al_tag = 'annotated'")
    row = done.agg(
        F.count("*").alias("annotated"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.countDistinct(F.date_format("created_at", "yyyy-MM")).alias("months"),
    )
    tuned = F.col("type") == "supervised_finetune"
    accepted = tuned & F.coalesce(F.get_json_object("progress", "$.accepted") == "true", F.lit(False))
    work = jobs.agg(F.count_if(tuned).alias("triggered"), F.count_if(accepted).alias("accepted"), F.count_if((F.col("type") == "reembed") & (F.col("status") == "finished")).alias("reembeds"))
    days = F.greatest(F.timestamp_diff("MICROSECOND", F.col("first_at"), F.col("last_at")) / 86400e6, F.lit(1.0))
    days = F.when(F.col("first_at").isNotNull(), days)
    rate = F.when(days >= LEAST_DAYS, F.col("annotated") / (days / 7))
    row = row.join(F.broadcast(work)).withColumn("days", days).withColumn("per_week", rate)  # one row each
    verdict = F.when(rate.isNull(), "INSUFFICIENT_DATA").when(rate < LOW_A_WEEK, "LOW_FREQUENCY").when(rate < HIGH_A_WEEK, "MODERATE_FREQUENCY").otherwise("HIGH_FREQUENCY")
    share = F.when(F.col("triggered") > 0, F.round(F.col("accepted") / F.col("triggered"), 3))
    return row.withColumn("acceptance_rate", share).withColumn("minutes_saved", F.col("accepted") * MINUTES_A_RELOAD).withColumn("verdict", verdict)


def robots(missions: DataFrame) -> DataFrame:
    """Distinct robots in order."""
    return missions.select("robot_id").filter("robot_id is not null").distinct().orderBy("robot_id")


def session_summary(packets: DataFrame) -> DataFrame:
    """Packets of each session by sensor, duration (at least 0) and last packet."""
    by_sensor = packets.groupBy("session_id", "sensor_type").agg(
        F.count("*").alias("n"), F.min("t_device").alias("low"), F.max("t_device").alias("high"), F.max(F.struct("t_device", "packet_id")).alias("last")
    )
    return by_sensor.groupBy("session_id").agg(
        F.sum("n").alias("packets"), F.greatest(F.lit(0.0), F.max("high") - F.min("low")).alias("duration_sec"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sensor_type", "n")))).alias("by_sensor"), F.max("last").getField("packet_id").alias("last_packet"),
    )


def sensor_profile(packets: DataFrame, capabilities: dict[str, str]) -> DataFrame:
    """Sorted sensors of each session and the capabilities they give."""
    pairs = [x for k, v in capabilities.items() for x in (F.lit(k), F.lit(v))]
    sensors = packets.groupBy("session_id").agg(F.array_sort(F.collect_set("sensor_type")).alias("sensors"))
    gives = F.filter(F.transform("sensors", lambda s: F.create_map(*pairs)[s]), lambda c: c.isNotNull())
    return sensors.withColumn("capabilities", F.array_sort(F.array_distinct(gives)))


def risk_summary(frames: DataFrame, expert: str = "$.expert") -> DataFrame:
    """Analysed and high-risk frames of each mission, and how often their experts agreed, by kind.

    The expert's answer is an object at a path of the facts; one that says that
    its service was unavailable or its answer unreadable isn't analysed, and what
    an answer doesn't say is unknown.
    """
    at = lambda path: F.get_json_object("facts", f"{expert}{path}")
    failed = lambda path: F.coalesce(~at(path).isin("false", "null", "", "0"), F.lit(False))
    rows = frames.filter(at("").startswith("{")).filter(~failed(".service_unavailable") & ~failed(".parse_error"))
    rows = rows.select("mission_id", F.coalesce(at(".understanding.risk_level"), F.lit("unknown")).alias("risk"), F.coalesce(at(".mixture_of_experts.expert_agreement"), F.lit("unknown")).alias("agreement"))
    by_kind = rows.groupBy("mission_id", "agreement").agg(F.count("*").alias("n"), F.count_if(F.col("risk") == "high").alias("high"))
    return by_kind.groupBy("mission_id").agg(F.sum("n").alias("analysed"), F.sum("high").alias("high_risk"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("agreement", "n")))).alias("agreement"))


def segment_summary(masks: DataFrame, least_area: float, top: int) -> DataFrame:
    """Masks of each frame above an area, the best by (score, area): labels and areas."""
    order = Window.partitionBy("frame_id").orderBy(F.desc("score"), F.desc("area"), "mask_id")
    kept = masks.filter(F.col("area") >= least_area).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    labels = kept.groupBy("frame_id", "label").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.max("area").alias("most"))
    return labels.groupBy("frame_id").agg(
        F.sum("n").alias("n_masks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("by_label"), (F.sum("area") / F.sum("n")).alias("mean_area"), F.max("most").alias("max_area")
    )


def al_tags(frames: DataFrame, k: int, threshold: float) -> DataFrame:
    """Active-learning score and tag of each frame.

    Distance and lack of confidence weigh 0.60 and 0.40, or 0.35 and 0.25 beside
    0.40 of surprise in a mission of which any is known.  What is missing counts
    as 0.5, and so does a confidence of 0, which no caption gives.  The best ``k``
    of a mission are to be annotated; other frames at the distance threshold are novel.
    """
    mission = Window.partitionBy("mission_id")
    half = lambda c: F.coalesce(c, F.lit(0.5))
    doubt, dist = F.lit(1.0) - half(F.nullif(F.col("caption_confidence"), F.lit(0.0))), half(F.col("dist"))
    surprised = F.count("surprise").over(mission) > 0
    score = F.when(surprised, 0.35 * dist + 0.25 * doubt + 0.40 * half(F.col("surprise"))).otherwise(0.60 * dist + 0.40 * doubt)
    place = F.row_number().over(mission.orderBy(F.desc("al_score"), "frame_id"))
    rows = frames.drop("al_score", "al_tag").withColumn("al_score", score).withColumn("place", place)
    return rows.withColumn("al_tag", F.when(F.col("place") <= k, "needs_annotation").when(dist >= threshold, "novel")).drop("place")


def mission_report(frames: DataFrame) -> DataFrame:
    """Frames, duration and tags of each mission."""
    return frames.groupBy("mission_id").agg(
        F.count("*").alias("frames"), (F.max("t_sec") - F.min("t_sec")).alias("duration_sec"), *[F.count_if(F.col("al_tag") == t).alias(t) for t in ("needs_annotation", "novel", "annotated")],
        F.max("al_score").alias("best_score"),
    )


def retrain_due(frames: DataFrame, jobs: DataFrame, watermark: int, least: int = 50, fresh: int = 100) -> DataFrame:
    """One row: annotated frames, those beyond the count at the last retraining, active jobs, and whether to retrain."""
    row = frames.agg(F.count_if(F.col("al_tag") == "annotated").alias("annotated")).withColumn("fresh", F.col("annotated") - watermark)
    active = jobs.agg(F.count_if((F.col("type") == "supervised_finetune") & F.col("status").isin("pending", "running")).alias("active"))
    return row.join(F.broadcast(active)).withColumn("due", (F.col("annotated") >= least) & (F.col("fresh") >= fresh) & (F.col("active") == 0))  # one row each


def mission_summary(tracks: DataFrame, events: DataFrame, geometry: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a run (mission_id, profile, metric_scale, degradations): tracks, observations by label, accepted events, samples, scale, stages that degraded.

    The accepted events themselves are the rows of ``events``, one document of all
    of them isn't made.  A run without a manifest has no scale: it is unavailable.
    """
    by_label = tracks.groupBy("mission_id", "label").agg(F.count("*").alias("n"))
    labels = by_label.groupBy("mission_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"), F.sum("n").alias("observations"))
    by_track = tracks.groupBy("mission_id").agg(F.countDistinct("track_id").alias("tracks"))
    by_event = events.filter("status = 'accepted'").groupBy("mission_id").agg(F.count("*").alias("accepted_events"))
    by_sample = geometry.groupBy("mission_id").agg(F.count("*").alias("samples"))
    found = runs.select("mission_id", "profile", "metric_scale", "degradations")
    for part in (by_track, labels, by_event, by_sample):
        found = found.join(part, "mission_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select(
        "mission_id", "profile", none("tracks"), none("observations"), F.coalesce("labels", F.create_map().cast("map<string,bigint>")).alias("labels"), none("accepted_events"), none("samples"), F.coalesce("metric_scale", F.lit("unavailable")).alias("metric_scale"),
        F.array_sort(F.array_distinct(F.coalesce("degradations", F.array().cast("array<string>")))).alias("degradations"),
    )


def count_disagreement(tracks: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts that the active observations at their time don't bear out: (mission_id, t_sec, label, counted, active, off)."""
    from .intervals import ACTIVE

    active = tracks.filter(F.col("state").isin(*ACTIVE)).groupBy("mission_id", "t_sec", "label").agg(F.count("*").alias("active"))
    met = counts.join(active, ["mission_id", "t_sec", "label"], "left").withColumn("active", F.coalesce("active", F.lit(0)))
    return met.filter("counted <> active").withColumn("off", F.abs(F.col("counted") - F.col("active")))


def gap_coverage(stages: DataFrame, gaps: DataFrame) -> DataFrame:
    """Missions whose skipped frames and gap rows disagree."""
    skipped = stages.groupBy("mission_id").agg(F.sum("skipped").alias("skipped"))
    covered = gaps.groupBy("mission_id").agg(F.sum("skipped_frames").alias("covered"))
    both = skipped.join(covered, "mission_id", "full").select("mission_id", F.coalesce("skipped", F.lit(0)).alias("skipped"), F.coalesce("covered", F.lit(0)).alias("covered"))
    return both.filter("skipped <> covered")


def voxelise(points: DataFrame, size: float) -> DataFrame:
    """One mean point for each cell of a cloud."""
    cell = [F.floor(F.col(c) / size).alias(f"v{c}") for c in ("x", "y", "z")]
    return points.groupBy("cloud_id", *cell).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))


def transform_cloud(points: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Points of a cloud under a rigid 4x4 transform."""
    moved = [sum((F.col(c) * float(row[k]) for k, c in enumerate("xyz")), F.lit(float(row[3]))).alias(a) for row, a in zip(matrix, "xyz")]
    return points.select(*[c for c in points.columns if c not in "xyz"], *moved)


def merge_clouds(a: DataFrame, b: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """The first cloud and the second one in its frame."""
    return a.unionByName(transform_cloud(b, matrix))


def fuse_motion(points: DataFrame, window_sec: float = 1.0) -> DataFrame:
    """Dynamic points of the last second, shifted to each subject's newest centre.

    Points of static subjects are returned as they are.
    """
    dynamic = points.filter("dynamic")
    newest = dynamic.groupBy(F.col("mission_id").alias("m"), F.col("subject_id").alias("s")).agg(F.max("t_sec").alias("last"))
    recent = dynamic.join(newest, (F.col("mission_id") == F.col("m")) & (F.col("subject_id") == F.col("s"))).filter(F.col("t_sec") >= F.col("last") - window_sec).drop("m", "s")
    centre = recent.groupBy(F.col("mission_id").alias("m"), F.col("subject_id").alias("s"), F.col("t_sec").alias("t")).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    target = centre.groupBy(F.col("m").alias("tm"), F.col("s").alias("ts")).agg(*[F.max_by(f"c{c}", "t").alias(f"n{c}") for c in "xyz"])
    met = recent.join(centre, (F.col("mission_id") == F.col("m")) & (F.col("subject_id") == F.col("s")) & (F.col("t_sec") == F.col("t"))).join(target, (F.col("mission_id") == F.col("tm")) & (F.col("subject_id") == F.col("ts")))
    shifted = met.select("mission_id", "subject_id", "t_sec", "dynamic", *[(F.col(c) - F.col(f"c{c}") + F.col(f"n{c}")).alias(c) for c in "xyz"])
    return shifted.unionByName(points.filter("not dynamic").select("mission_id", "subject_id", "t_sec", "dynamic", "x", "y", "z"))


def prototypes(embeddings: DataFrame, tau: float = 2.0) -> DataFrame:
    """Time-decayed vector of each track and embedding space.

    Each observation, in order of (t_sec, observation_id), replaces the share
    1 - exp(-dt / tau) of what was before, dt after its forerunner.  So an
    observation's weight in the end is its share times exp(-age / tau), and the
    first one's is exp(-age / tau) alone: sums, without a loop over observations.
    """
    order = Window.partitionBy("track_id", "space").orderBy("t_sec", "observation_id")
    newest = embeddings.groupBy(F.col("track_id").alias("k"), F.col("space").alias("sp")).agg(F.max("t_sec").alias("last"))
    gap = embeddings.withColumn("before", F.lag("t_sec").over(order)).join(newest, (F.col("track_id") == F.col("k")) & (F.col("space") == F.col("sp")))
    share = F.when(F.col("before").isNull(), 1.0).otherwise(F.lit(1.0) - F.exp((F.col("before") - F.col("t_sec")) / max(tau, 1e-6)))
    weighted = gap.withColumn("weight", share * F.exp((F.col("t_sec") - F.col("last")) / max(tau, 1e-6)))
    parts = weighted.filter("weight > 0").select("track_id", "space", "weight", F.posexplode("vector").alias("at", "x"))
    means = parts.groupBy("track_id", "space", "at").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return means.groupBy("track_id", "space").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("prototype"))
