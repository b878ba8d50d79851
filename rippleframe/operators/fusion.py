"""Weighted fusion, localisation and viewing geometry of groups of any size.

Everything is a sum over the group, so hot groups combine map-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions import geo
from rippleframe.operators.sequence import attach, framed, running, sequence

TAU = 2 * math.pi


def attention_score(
    quality: Column, coherence: Column, distance: Column, powers=(1.0, 1.0, 1.0), d0: float = 1.0, temperature: float = 1.0
) -> Column:
    a, b, k = powers
    s = F.pow(quality, F.lit(a)) * F.pow(coherence, F.lit(b)) / F.pow(1.0 + distance / d0, F.lit(k))
    return F.pow(s, F.lit(1.0 / temperature))


def fuse_attention(df: DataFrame, key: Sequence[str], score: Column, value: Column, quality: Column) -> DataFrame:
    """Attention-weighted value and quality, and the normalised weight entropy.

    With w = s / S the entropy is ln S - sum(s ln s) / S, hence one pass. A group
    without positive scores gets uniform weights.
    """
    rows = df.select(*key, score.alias("s"), value.alias("v"), quality.alias("q"))
    total = F.sum("s")
    n = F.count(F.lit(1))
    slog = F.sum(F.when(F.col("s") > 0, F.col("s") * F.log("s")).otherwise(F.lit(0.0)))
    entropy = F.when(n <= 1, F.lit(0.0)).when(total > 0, (F.log(total) - slog / total) / F.log(n)).otherwise(F.lit(1.0))
    pick = lambda c: F.when(total > 0, F.sum(F.col("s") * F.col(c)) / total).otherwise(F.avg(c))
    return rows.groupBy(*key).agg(
        n.alias("n"), pick("v").alias("fused"), pick("q").alias("fused_quality"), entropy.alias("entropy")
    )


def fuse_positions(
    df: DataFrame, key: Sequence[str], x: str, y: str, weight: Column, sigma_h: Column, sigma_v: Column, confidence: Column,
    min_variance: float = 1e-6,
) -> DataFrame:
    """Inverse-variance position, fused horizontal error and confidence.

    Keys with a single estimate keep it unchanged: its weight cancels in the mean.
    """
    var = (2.0 * F.greatest(sigma_h * sigma_h, F.lit(min_variance)) + F.greatest(sigma_v * sigma_v, F.lit(min_variance))) / 3.0
    rows = df.select(*key, F.col(x).alias("x"), F.col(y).alias("y"), (weight * confidence / var).alias("w"), confidence.alias("c"), sigma_h.alias("h"))
    total = F.sum("w")
    single = F.count(F.lit(1)) == 1
    mean_conf = F.sum(F.col("w") * F.col("c")) / total
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("w") * F.col("x")) / total).alias("x"),
        (F.sum(F.col("w") * F.col("y")) / total).alias("y"),
        F.when(single, F.max("h")).otherwise(F.sqrt(1.0 / F.greatest(total, F.lit(min_variance)))).alias("sigma"),
        F.when(single, F.max("c")).otherwise(F.least(F.lit(0.99), mean_conf + 0.02)).alias("confidence"),
    )


def trilaterate(
    df: DataFrame, key: Sequence[str], order: Sequence[str], x: str, y: str, distance: str, confidence: Column
) -> DataFrame:
    """Weighted linear least squares against the first anchor (by ``order``) of each group.

    The two-by-two normal equations are sums; at least three anchors are needed.
    """
    rows = df.select(*key, *order, F.col(x).alias("x"), F.col(y).alias("y"), F.col(distance).alias("d"), confidence.alias("c"))
    rows = rows.withColumn("v", F.pow(geo.distance_sigma(F.col("d")), 2))
    first = rows.groupBy(*key).agg(F.min_by(F.struct("x", "y", "d", "c", "v"), F.struct(*order)).alias("ref"), F.count(F.lit(1)).alias("n"))
    both = attach(rows, first, key)
    r = lambda f: F.col(f"ref.{f}")
    ax, ay = 2 * (F.col("x") - r("x")), 2 * (F.col("y") - r("y"))
    sq = lambda c: c * c
    b = sq(r("d")) - sq(F.col("d")) - sq(r("x")) + sq(F.col("x")) - sq(r("y")) + sq(F.col("y"))
    # The first anchor's own equation is all zeros and adds nothing.
    w = F.greatest(r("c") * F.col("c"), F.lit(1e-6)) / F.greatest(r("v") + F.col("v"), F.lit(1e-6))
    both = both.withColumns({"_ax": ax, "_ay": ay, "_b": b, "_w": w})
    s = both.groupBy(*key).agg(
        F.first("n").alias("n"),
        *[F.sum(F.col("_w") * F.col(p) * F.col(q)).alias(n) for n, p, q in (
            ("xx", "_ax", "_ax"), ("xy", "_ax", "_ay"), ("yy", "_ay", "_ay"), ("bx", "_ax", "_b"), ("by", "_ay", "_b"))],
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    fixed = s.filter("n >= 3").withColumn("_det", det).filter(F.abs("_det") > 1e-12)
    fixed = fixed.select(
        *key, "n",
        ((F.col("bx") * F.col("yy") - F.col("by") * F.col("xy")) / F.col("_det")).alias("px"),
        ((F.col("by") * F.col("xx") - F.col("bx") * F.col("xy")) / F.col("_det")).alias("py"),
    )
    back = attach(rows, fixed, key, "inner")
    res = F.col("d") - F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    rmse = back.groupBy(*key).agg(F.sqrt(F.avg(res * res)).alias("rmse"))
    return attach(fixed, rmse, key)


def mean_pair_angle(df: DataFrame, key: Sequence[str], angle: str, tie: Sequence[str]) -> DataFrame:
    """Mean angle between all pairs of directions, in n log n.

    With angles sorted in [0, 2 pi), a later direction is d away when it lies within
    half a turn and 2 pi - d away beyond it. Counts and sums of the directions up to
    each angle, and up to half a turn further, give the sum over all pairs; both come
    from one running aggregate over points and half-turn marks.
    """
    theta = F.pmod(F.col(angle), F.lit(TAU))
    pts = df.select(*key, *tie, theta.alias("_t"))
    both = pts.select(
        *key, *tie, F.explode(F.array(F.struct(F.lit(0).alias("mark"), F.col("_t").alias("at")), F.struct(F.lit(1).alias("mark"), (F.col("_t") + math.pi).alias("at")))).alias("e")
    ).select(*key, *tie, "e.*")
    seq = sequence(both, key, ["at", "mark", *tie])
    point = F.col("mark") == 0
    seq = running(seq, key, {
        "_c": ("sum", point.cast("bigint")),
        "_s": ("sum", F.when(point, F.col("at")).otherwise(F.lit(0.0))),
    })
    own = F.col("at") - math.pi
    term = F.when(point, F.col("at") * F.col("_c") - F.col("_s")).otherwise(
        2 * F.col("_s") - 2 * own * F.col("_c") - TAU * F.col("_c")
    )
    n = F.sum(point.cast("bigint"))
    out = seq.groupBy(*key).agg(n.alias("n"), F.sum(term).alias("_sum"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    total = F.col("_sum") + TAU * F.col("n") * F.col("n")
    return out.select(*key, "n", F.when(F.col("n") >= 2, total / pairs).alias("mean_angle"))


def nearest_angle(df: DataFrame, key: Sequence[str], angle: str, tie: Sequence[str]) -> DataFrame:
    """Mean and minimum angular distance to the nearest other direction of the key."""
    rows = df.select(*key, *tie, F.pmod(F.col(angle), F.lit(TAU)).alias("_t"))
    seq = sequence(rows, key, ["_t", *tie])
    seq = framed(seq, key, {"_p": lambda w: F.lag("_t").over(w), "_n": lambda w: F.lead("_t").over(w)}, before=1, after=1)
    ends = seq.groupBy(*key).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("n"))
    seq = attach(seq, ends, key).filter("n >= 2")
    before = F.coalesce(F.col("_t") - F.col("_p"), F.col("_t") - F.col("_hi") + TAU)
    after = F.coalesce(F.col("_n") - F.col("_t"), F.col("_lo") + TAU - F.col("_t"))
    turn = lambda d: F.least(d, TAU - d)
    sep = F.least(turn(before), turn(after))
    return seq.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(sep).alias("diversity"), F.min(sep).alias("worst"))


def fisher_bound(df: DataFrame, key: Sequence[str], dx: Column, dy: Column, sigma: Column, ridge: float = 0.0) -> DataFrame:
    """Position error bound from the two-by-two Fisher information."""
    r = F.greatest(F.hypot(dx, dy), F.lit(1e-6))
    rows = df.select(*key, (dx / r).alias("c"), (dy / r).alias("s"), (1.0 / F.greatest(sigma * sigma, F.lit(1e-10))).alias("w"))
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("w") * F.col("c") * F.col("c")) + ridge).alias("a"),
        F.sum(F.col("w") * F.col("c") * F.col("s")).alias("b"),
        (F.sum(F.col("w") * F.col("s") * F.col("s")) + ridge).alias("d"),
    )
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    out = out.withColumn("_det", det).filter((F.col("n") >= 3) & (F.abs("_det") >= 1e-12))
    return out.select(
        *key, "n", (F.col("d") / F.col("_det")).alias("crb_x"), (F.col("a") / F.col("_det")).alias("crb_y"),
        F.sqrt(F.greatest((F.col("a") + F.col("d")) / F.col("_det"), F.lit(0.0))).alias("gdop"),
    )


def fresnel_split(df: DataFrame, key: Sequence[str], wavelength: Column, amplitude: Column, total_m: float, ridge: float = 0.05, shortest: float = 0.1) -> DataFrame:
    """Distances on both sides of a reflector from wavelength / amplitude samples."""
    rows = df.select(*key, wavelength.alias("w"), amplitude.alias("a"))
    # The residual expands into sums as well: e = (2 d1 - D) / w - a.
    s = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(1.0 / (F.col("w") * F.col("w"))).alias("ww"),
        F.sum(F.col("a") / F.col("w")).alias("aw"),
        F.sum(F.col("a") * F.col("a")).alias("aa"),
    ).filter("n >= 3")
    low = min(shortest, total_m / 2)
    d1 = F.greatest(F.lit(low), F.least(F.lit(total_m - low), F.abs(F.col("aw") / (ridge + F.col("ww")))))
    s = s.withColumn("d1", d1)
    u = 2 * F.col("d1") - total_m
    mse = (u * u * F.col("ww") - 2 * u * F.col("aw") + F.col("aa")) / F.col("n")
    return s.select(*key, "n", "d1", (total_m - F.col("d1")).alias("d2"), F.sqrt(F.greatest(mse, F.lit(0.0))).alias("residual"))
