"""Quality of tracks, relations, events and answers against the truth.

One row a mission; null where a metric is undefined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import distance_3d, iou_2d, iou_3d, temporal_iou
from .joins import prefixed

#: States whose boxes count as found; an occluded box is a guess of the tracker.
ACTIVE = "state in ('tentative', 'confirmed')"
IOU = 0.5
#: Pixels that are unpacked at once.
PIXELS = 4_000_000



def greedy_scan(pairs: DataFrame, scope: Sequence[str], order: Sequence[Column], left: str, right: str) -> DataFrame:
    """Takes the pairs of each scope in order and uses each side once.

    Scopes are dealt by hash and sorted in their task; one pass over the sorted
    rows needs the sides used in the current scope only.
    """
    names = pairs.columns

    def take(frames):
        last, used_l, used_r = None, set(), set()
        for frame in frames:
            keep = []
            for i, row in enumerate(zip(frame[left].tolist(), frame[right].tolist(), *(frame[c].tolist() for c in scope))):
                if row[2:] != last:
                    last, used_l, used_r = row[2:], set(), set()
                if row[0] not in used_l and row[1] not in used_r:
                    used_l.add(row[0])
                    used_r.add(row[1])
                    keep.append(i)
            yield frame.iloc[keep]

    return pairs.repartition(*scope).sortWithinPartitions(*scope, *order).select(*names).mapInPandas(take, pairs.schema)


def frame_matches(pred: DataFrame, truth: DataFrame, least: float = IOU) -> DataFrame:
    """One-to-one matches of boxes in each frame, best overlap first: (mission_id, t_sec, track_id, gt_id, iou).

    Only pairs above the threshold are formed, in one frame at a time; of equal
    overlaps the larger ids come first.
    """
    box = lambda p: tuple(F.col(f"{p}{c}") for c in "xywh")
    met = pred.join(prefixed(truth, "g_"), (F.col("mission_id") == F.col("g_mission_id")) & (F.col("t_sec") == F.col("g_t_sec")))
    pairs = met.withColumn("iou", F.round(iou_2d(box(""), box("g_")), 9)).filter(F.col("iou") >= least).select("mission_id", "t_sec", "track_id", F.col("g_gt_id").alias("gt_id"), "iou")

    return greedy_scan(pairs, ["mission_id", "t_sec"], [F.desc("iou"), F.desc("track_id"), F.desc("gt_id")], "track_id", "gt_id")


def detection_counts(pred: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """True and false positives and misses of each mission."""
    p = pred.groupBy("mission_id").agg(F.count("*").alias("n_pred"))
    g = truth.groupBy("mission_id").agg(F.count("*").alias("n_truth"))
    m = matches.groupBy("mission_id").agg(F.count("*").alias("tp"))
    rows = p.join(g, "mission_id", "full").join(m, "mission_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("mission_id", zero("tp").alias("tp"), (zero("n_pred") - zero("tp")).alias("fp"), (zero("n_truth") - zero("tp")).alias("fn"))


def tracking_quality(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """HOTA at 0.5, IDF1 and identity switches by majority assignment."""
    matches = frame_matches(pred, truth)
    order = Window.partitionBy("mission_id", "track_id").orderBy("t_sec", "gt_id")
    stepped = matches.withColumn("switch", F.coalesce((F.lag("gt_id").over(order) != F.col("gt_id")).cast("int"), F.lit(0))).withColumn("nth", F.row_number().over(order))
    by_pair = stepped.groupBy("mission_id", "track_id", "gt_id").agg(F.count("*").alias("n"), F.min("nth").alias("first"), F.sum("switch").alias("switches"))
    # The truth met most often; of equals the one met first.
    by_track = by_pair.groupBy("mission_id", "track_id").agg(F.max(F.struct("n", (-F.col("first")).alias("first"))).getField("n").alias("agreed"), F.sum("n").alias("n"), F.sum("switches").alias("switches"))
    total = by_track.groupBy("mission_id").agg(F.sum("agreed").alias("agreed"), F.sum("n").alias("n"), F.sum("switches").alias("switches"))
    rows = detection_counts(pred, truth, matches).join(total, "mission_id", "left")
    agreed, n = F.coalesce("agreed", F.lit(0)), F.coalesce("n", F.lit(0))
    some = F.col("tp") + F.col("fp") + F.col("fn") > 0
    det = F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))
    hota = F.when(~some, None).when(n == 0, 0.0).otherwise(F.sqrt(det * (agreed / n)))
    off = n - agreed
    idf1 = F.when(~some, None).when(n == 0, 0.0).otherwise(2 * agreed / (2 * agreed + F.col("fp") + off + F.col("fn") + off))
    return rows.select("mission_id", "tp", "fp", "fn", F.round(hota, 6).alias("hota"), F.round(idf1, 6).alias("idf1"), F.when(some, F.coalesce("switches", F.lit(0))).alias("switches"))


def grounding(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Average precision and recall of each mission.

    For the precision predictions go by confidence and each takes its best free
    truth; frames don't share truths, so the greedy step runs frame by frame.  The
    recall is that of :func:`frame_matches`, whose pairs go by overlap.
    """
    box = lambda p: tuple(F.col(f"{p}{c}") for c in "xywh")
    met = pred.join(prefixed(truth, "g_"), (F.col("mission_id") == F.col("g_mission_id")) & (F.col("t_sec") == F.col("g_t_sec")), "left")
    pairs = met.withColumn("iou", F.coalesce(F.round(iou_2d(box(""), box("g_")), 9), F.lit(0.0))).select("mission_id", "t_sec", "track_id", "confidence", F.col("g_gt_id").alias("gt_id"), "iou")

    def take(frames):
        scope, last, done, taken = None, None, False, set()
        for frame in frames:
            rows = []
            for m, t, track, conf, gt, iou in frame.itertuples(index=False):
                if (m, t) != scope:
                    scope, last, taken = (m, t), None, set()
                if (track, conf) != last:  # the next prediction; its pairs follow, best first
                    last, done = (track, conf), False
                if not done and iou > 0 and gt not in taken:
                    done = True  # the best free truth decides
                    if iou >= IOU:
                        taken.add(gt)
                        rows.append((m, t, track, conf))
            yield pd.DataFrame(rows, columns=["mission_id", "t_sec", "track_id", "confidence"])

    dealt = pairs.repartition("mission_id", "t_sec").sortWithinPartitions("mission_id", "t_sec", F.desc("confidence"), "track_id", F.desc("iou"), "gt_id")
    found = dealt.mapInPandas(take, dealt.select("mission_id", "t_sec", "track_id", "confidence").schema).withColumn("hit", F.lit(1))
    keys = ["mission_id", "t_sec", "track_id", "confidence"]
    hits = pred.select(*keys).join(found, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    order = Window.partitionBy("mission_id").orderBy(F.desc("confidence"), "t_sec", "track_id")
    steps = hits.withColumn("precision", F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(order))
    n_truth = truth.groupBy("mission_id").agg(F.count("*").alias("n_truth"))
    ap = steps.filter("hit = 1").groupBy("mission_id").agg(F.sum("precision").alias("gain"))
    met = frame_matches(pred, truth).groupBy("mission_id").agg(F.count("*").alias("met"))
    both = pred.select("mission_id").distinct().join(n_truth, "mission_id", "full").join(ap, "mission_id", "left").join(met, "mission_id", "left")
    n = F.coalesce("n_truth", F.lit(0))
    return both.select("mission_id", F.round(F.when(n > 0, F.coalesce("gain", F.lit(0.0)) / n).otherwise(0.0), 6).alias("ap"), F.round(F.when(n > 0, F.coalesce("met", F.lit(0)) / n).otherwise(0.0), 6).alias("recall"))


def coverage(boundaries: DataFrame, keyframes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Share of boundaries with a keyframe within the tolerance."""
    b = boundaries.select("mission_id", "t_sec", F.floor(F.col("t_sec") / tolerance).alias("bucket"))
    k = keyframes.select(F.col("mission_id").alias("k_m"), F.col("t_sec").alias("k_t"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("t_sec") / tolerance) + d)).alias("k_bucket"))
    met = b.join(k, (F.col("mission_id") == F.col("k_m")) & (F.col("bucket") == F.col("k_bucket")) & (F.abs(F.col("t_sec") - F.col("k_t")) <= tolerance), "left_semi")
    hit = met.groupBy(F.col("mission_id").alias("m")).agg(F.count("*").alias("hit"))
    every = b.groupBy("mission_id").agg(F.count("*").alias("n"))
    return every.join(hit, F.col("mission_id") == F.col("m"), "left").select("mission_id", F.round(F.coalesce("hit", F.lit(0)) / F.col("n"), 6).alias("coverage"))


def count_mae(tracks: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean absolute error of active tracks against counts of (t_sec, label)."""
    active = tracks.filter(ACTIVE).groupBy("mission_id", "t_sec", "label").agg(F.count("*").alias("n"))
    met = counts.join(active, ["mission_id", "t_sec", "label"], "left")
    return met.groupBy("mission_id").agg(F.round(F.avg(F.abs(F.coalesce("n", F.lit(0)) - F.col("count"))), 6).alias("mae"))


def _same_sample(pred: DataFrame, truth: DataFrame, how: str) -> DataFrame:
    p = prefixed(pred, "p_")
    return truth.join(p, (F.col("mission_id") == F.col("p_mission_id")) & (F.col("subject_id") == F.col("p_subject_id")) & (F.col("t_sec") == F.col("p_t_sec")), how)


def depth_error(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean absolute depth error; relative missions divide both series by their upper median."""
    met = _same_sample(pred.filter("depth_m is not null"), truth, "inner").select("mission_id", F.col("p_depth_m").alias("p"), F.col("depth_m").alias("g"), F.col("p_metric_scale").alias("scale"))
    relative = met.groupBy(F.col("mission_id").alias("m")).agg(F.bool_or(F.col("scale") == "relative").alias("relative"), F.count("*").alias("n"))
    middle = lambda c: (  # noqa: E731  the upper median, at n // 2 from 0
        met.withColumn("nth", F.row_number().over(Window.partitionBy("mission_id").orderBy(c))).join(relative, F.col("mission_id") == F.col("m"))
        .filter(F.col("nth") == F.floor(F.col("n") / 2) + 1).select(F.col("mission_id").alias(f"m_{c}"), F.col(c).alias(f"median_{c}"))
    )
    rows = met.join(relative, F.col("mission_id") == F.col("m")).join(middle("p"), F.col("mission_id") == F.col("m_p")).join(middle("g"), F.col("mission_id") == F.col("m_g"))
    by = lambda c: F.when(F.col("relative") & (F.col(f"median_{c}") != 0), F.col(c) / F.col(f"median_{c}")).otherwise(F.col(c))
    return rows.groupBy("mission_id").agg(F.round(F.avg(F.abs(by("p") - by("g"))), 6).alias("depth_mae"))


def box_quality(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean 3D overlap (0 for a missing sample) and mean centre error."""
    names = ("cx", "cy", "cz", "ex", "ey", "ez")
    met = _same_sample(pred, truth, "left")
    here = F.col("p_mission_id").isNotNull()
    iou = F.when(here, iou_3d(tuple(F.col(f"p_{c}") for c in names), tuple(F.col(c) for c in names))).otherwise(F.lit(0.0))
    off = F.when(here, distance_3d(tuple(F.col(f"p_{c}") for c in names[:3]), tuple(F.col(c) for c in names[:3])))
    return met.groupBy("mission_id").agg(F.round(F.avg(iou), 6).alias("iou_3d"), F.round(F.avg(off), 6).alias("centre_error_m"))


def interval_matches(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy matches of intervals of one key, in order of the prediction's id: (keys, pred_id, truth_id, iou).

    Every key is small; the candidates are formed by its equality join.
    """
    met = pred.join(prefixed(truth, "g_"), [F.col(k) == F.col(f"g_{k}") for k in keys])
    pairs = met.withColumn("iou", F.round(temporal_iou(F.col("start_sec"), F.col("end_sec"), F.col("g_start_sec"), F.col("g_end_sec")), 9)).filter("iou > 0")
    pairs = pairs.select(*keys, "pred_id", F.col("g_truth_id").alias("truth_id"), "iou")

    return greedy_scan(pairs, list(keys), [F.col("pred_id"), F.desc("iou"), F.col("truth_id")], "pred_id", "truth_id")


def interval_quality(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and mean overlap of matched intervals of each mission."""
    found = interval_matches(pred, truth, keys).groupBy("mission_id").agg(F.count("*").alias("hit"), F.avg("iou").alias("mean_iou"))
    n = pred.groupBy("mission_id").agg(F.count("*").alias("n_pred")).join(truth.groupBy("mission_id").agg(F.count("*").alias("n_truth")), "mission_id", "full").join(found, "mission_id", "left")
    share = lambda c: F.when(F.col(c) > 0, F.coalesce("hit", F.lit(0)) / F.col(c)).otherwise(F.lit(0.0))
    rows = n.withColumn("precision", share("n_pred")).withColumn("recall", share("n_truth"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return rows.select("mission_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round("mean_iou", 6).alias("mean_iou"))


def verifier_rates(proposals: DataFrame, expected: DataFrame) -> DataFrame:
    """Shares of false accepts and false rejects over what should happen."""
    met = expected.join(proposals.select(F.col("proposal_id").alias("p"), "status"), F.col("proposal_id") == F.col("p"), "left")
    wrong = lambda want, status: F.avg(F.when(F.col("should_accept") == want, F.coalesce((F.col("status") == status).cast("double"), F.lit(0.0))))
    return met.groupBy("mission_id").agg(F.round(wrong(False, "accepted"), 6).alias("false_accept"), F.round(wrong(True, "rejected"), 6).alias("false_reject"))


def qa_accuracy(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of accepted answers that are as expected."""
    met = answers.filter("status = 'accepted'").join(expected.select(F.col("qa_id").alias("q"), F.col("answer").alias("want")), F.col("qa_id") == F.col("q"), "left")
    return met.groupBy("mission_id").agg(F.round(F.avg(F.coalesce((F.col("answer") == F.col("want")).cast("double"), F.lit(0.0))), 6).alias("accuracy"))


def edges(on: np.ndarray, width: int) -> np.ndarray:
    """Boundary pixels of masks (a mask a row of ``on``, pixels row by row)."""
    n, length = on.shape
    height = -(-length // width)
    px = np.zeros((n, height + 2, width + 2), bool)
    full = np.zeros((n, height * width), bool)
    full[:, :length] = on
    px[:, 1:-1, 1:-1] = full.reshape(n, height, width)
    inner = px[:, 2:, 1:-1] & px[:, :-2, 1:-1] & px[:, 1:-1, 2:] & px[:, 1:-1, :-2]
    return (px[:, 1:-1, 1:-1] & ~inner).reshape(n, -1)[:, :length]


def mask_counts(p: pd.Series, p_width: pd.Series, g: pd.Series, g_width: pd.Series) -> pd.DataFrame:
    """Pixels of pairs of masks: in both, in either, on both boundaries, on each one; masks of one shape are counted together."""
    rows = pd.DataFrame({"p": p.fillna(""), "pw": p_width.fillna(1).astype("int64"), "g": g.fillna(""), "gw": g_width.fillna(1).astype("int64")}).reset_index(drop=True)
    found = np.zeros((len(rows), 5), np.int64)
    bits = lambda texts, n: np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8).reshape(len(texts), n) == ord("1")
    for (np_, pw, ng, gw), at in rows.groupby([rows["p"].str.len(), "pw", rows["g"].str.len(), "gw"]).indices.items():
        step, n = max(1, PIXELS // max(np_, ng, 1)), max(np_, ng)
        for first in range(0, len(at), step):
            some = at[first : first + step]
            a, b, ae, be = (np.zeros((len(some), n), bool) for _ in range(4))
            a[:, :np_], b[:, :ng] = bits(rows["p"].iloc[some], np_), bits(rows["g"].iloc[some], ng)
            ae[:, :np_], be[:, :ng] = edges(a[:, :np_], pw), edges(b[:, :ng], gw)
            found[some] = np.stack([x.sum(axis=1) for x in (a & b, a | b, ae & be, ae, be)], axis=1)
    return pd.DataFrame(found, columns=["inter", "union", "hit", "n_p", "n_g"])


def mask_quality(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean overlap J and boundary F of masks (bits row by row, width): a missing mask counts 0.

    A boundary pixel is set and has a neighbour (4 sides) that isn't, or the mask's edge.
    Masks meet whole, by id, and are counted a batch at a time; no row is made for a pixel.
    """
    counts = F.pandas_udf(mask_counts, "inter long, union long, hit long, n_p long, n_g long")
    other = pred.select("mission_id", "mask_id", F.lit(1).alias("here"), F.col("bits").alias("p_bits"), F.col("width").alias("p_width"))
    met = truth.select("mission_id", "mask_id", "bits", "width").join(other, ["mission_id", "mask_id"], "left")
    rows = met.select("mission_id", "mask_id", "here", counts("p_bits", "p_width", "bits", "width").alias("c")).select("mission_id", "mask_id", "here", "c.*")
    precision, recall = F.col("hit") / F.col("n_p"), F.col("hit") / F.col("n_g")
    f = F.when(F.col("here").isNull() | (F.coalesce("hit", F.lit(0)) == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))
    j = F.when(F.col("here").isNull() | (F.col("union") == 0), 0.0).otherwise(F.col("inter") / F.col("union"))
    return rows.groupBy("mission_id").agg(F.round(F.avg(j), 6).alias("j"), F.round(F.avg(f), 6).alias("f"))


def roll_up(metrics: DataFrame, means: Sequence[str], sums: Sequence[str] = (), maxima: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """One row over all valid missions: means of the defined values, sums, maxima, and the required conditions that no mission covers.

    ``metrics`` has one row a mission; ``valid`` and ``conditions`` (an array) are optional.
    """
    rows = metrics.filter("valid") if "valid" in metrics.columns else metrics
    met = F.flatten(F.collect_set("conditions")) if "conditions" in rows.columns else F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), met)).alias("missing")
    if "conditions" in rows.columns:  # only those asked for, so that a mission adds few
        wanted = F.array(*map(F.lit, required)).cast("array<string>")
        rows = rows.withColumn("conditions", F.array_sort(F.array_intersect(F.coalesce("conditions", wanted), F.when(F.col("conditions").isNull(), F.array().cast("array<string>")).otherwise(wanted))))
    return rows.agg(F.count("*").alias("missions"), *[F.round(F.avg(c), 6).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(f"max_{c}") for c in maxima], missing)
