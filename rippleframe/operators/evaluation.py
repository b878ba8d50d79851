"""Pose metrics, losses, sweeps and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.functions import vectors as vec
from rippleframe.operators.sequence import attach

# Per-joint scale of the 17 body keypoints.
KEYPOINT_SIGMAS = [
    0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089,
]


def score_keypoints(poses: DataFrame, frame: Sequence[str], joint: str) -> DataFrame:
    """Distance, box-relative correctness and similarity of every visible keypoint.

    ``poses`` has pred_x, pred_y, gt_x, gt_y and visibility. Lengths are roots of sums of squares, since ``hypot``
    rounds otherwise and a keypoint at just the allowed share of its box would change sides.
    """
    length = lambda x, y: F.sqrt(x * x + y * y)
    seen = poses.filter(F.col("visibility") >= 0.5)
    box = seen.groupBy(*frame).agg(length(F.max("gt_x") - F.min("gt_x"), F.max("gt_y") - F.min("gt_y")).alias("_b"))
    rows = attach(seen, box.withColumn("_b", F.greatest("_b", F.lit(1e-3))), list(frame))
    d = length(F.col("pred_x") - F.col("gt_x"), F.col("pred_y") - F.col("gt_y"))
    sigma = F.coalesce(F.get(F.array(*[F.lit(s) for s in KEYPOINT_SIGMAS]), F.col(joint).cast("int")), F.lit(0.07))
    rows = rows.withColumn("distance", d)
    oks = F.exp(-F.col("distance") * F.col("distance") / (2 * F.pow(F.col("_b"), 2) * sigma * sigma + 1e-12))
    return rows.select(
        *frame, joint, "distance", (F.col("distance") <= 0.2 * F.col("_b")).alias("hit_02"), (F.col("distance") <= 0.5 * F.col("_b")).alias("hit_05"), oks.alias("oks"),
    )


def frame_metrics(scored: DataFrame, frame: Sequence[str]) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return scored.groupBy(*frame).agg(
        F.count(F.lit(1)).alias("keypoints"), share("hit_02").alias("pck_02"), share("hit_05").alias("pck_05"), F.avg("oks").alias("oks")
    )


def joint_metrics(scored: DataFrame, joint: str) -> DataFrame:
    return scored.groupBy(joint).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit_02").cast("double")).alias("pck_02"))


def threshold_sweep(df: DataFrame, score: Column, truth: Column, steps: int = 80) -> DataFrame:
    """False positive and negative rate and balanced accuracy at steps + 1 thresholds.

    Scores are counted once by the highest threshold they reach; the rates follow
    from running sums over those steps + 1 counts, not from one pass per threshold.
    """
    grid = F.array(*[F.lit(k / steps) for k in range(steps + 1)])
    reached = F.size(F.filter(grid, lambda t: F.col("_s") >= t)) - 1
    counts = df.select(score.alias("_s"), truth.alias("_t")).select(reached.alias("k"), "_t").groupBy("k").agg(
        F.count_if("_t").alias("p"), F.count_if(~F.col("_t")).alias("n")
    )
    every = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    counts = every.join(F.broadcast(counts), "k", "left").fillna(0, ["p", "n"])  # steps + 1 rows
    above = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = counts.select(
        "k", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(whole).alias("P"), F.sum("n").over(whole).alias("N")
    )
    fpr = F.col("fp") / F.greatest(F.col("N"), F.lit(1))
    fnr = (F.col("P") - F.col("tp")) / F.greatest(F.col("P"), F.lit(1))
    return out.select((F.col("k") / steps).alias("threshold"), fpr.alias("fpr"), fnr.alias("fnr"), (1 - (fpr + fnr) / 2).alias("balanced_accuracy"))


def cross_entropy(logits: Column | str, label: Column) -> Column:
    """-log softmax at ``label`` of a logit array; null for an ignored (null) label."""
    v = vec.col(logits)
    log_sum = vec.let(F.array_max(v), lambda m: m + F.log(vec.total(F.transform(v, lambda x: F.exp(x - m)))))
    return log_sum - F.get(v, label.cast("int"))


def smooth_l1(diff: Column, beta: float = 1.0) -> Column:
    a = F.abs(diff)
    return F.when(a < beta, 0.5 * diff * diff / beta).otherwise(a - 0.5 * beta) if beta > 0 else a


def total_loss(keypoint: Column, dense: Column, transfer: Column) -> Column:
    """Fixed weights .3 / .6 / .1."""
    return 0.3 * keypoint + 0.6 * dense + 0.1 * transfer


def gaussian_heatmap(x: Column, y: Column, size: int, sigma: float = 2.0, clip: float = 3.0) -> Column:
    """Flattened size x size grid with a clipped Gaussian at (x, y) in [0, 1]."""
    cx, cy = x * (size - 1), y * (size - 1)

    def cell(i):
        d2 = F.pow(i % size - cx, 2) + F.pow(F.floor(i / size) - cy, 2)
        return F.when(d2 <= (clip * sigma) ** 2, F.exp(-d2 / (2 * sigma * sigma))).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), cell)


def heatmap_keypoint(heatmap: Column | str, size: int) -> Column:
    """Normalised (x, y) of the largest cell, lowest index on ties."""
    at = vec.argmax(heatmap)
    return F.struct(((at % size) / (size - 1)).alias("x"), (F.floor(at / size) / (size - 1)).alias("y"))


def best_checkpoints(df: DataFrame, metric: str, epoch: str, path: str, k: int, mode: str = "max") -> DataFrame:
    """Top k by metric; later epoch, then path, decide ties."""
    first = F.desc(metric) if mode == "max" else F.asc(metric)
    return df.orderBy(first, F.desc(epoch), F.asc(path)).limit(k)
