"""State along a key, written as running aggregates so that no key needs one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.functions import scoring as sc
from rippleframe.operators.sequence import CHUNK, CORE, POS, chunked, framed, recurrence, running, sequence


def streaks(seq: DataFrame, key: Sequence[str], hits: dict[str, Column]) -> DataFrame:
    """Length of the current run of each condition; 0 where it does not hold."""
    out = running(seq, key, {f"_miss_{n}": ("last", F.when(~hit, F.col(POS))) for n, hit in hits.items()})
    for n in hits:
        out = out.withColumn(n, F.col(POS) - F.coalesce(F.col(f"_miss_{n}"), F.lit(-1))).drop(f"_miss_{n}")
    return out


def debounce(
    seq: DataFrame, key: Sequence[str], detected: str, confirm: int = 2, release: int = 2, size: int | None = None
) -> DataFrame:
    """Two-sided hysteresis: on after ``confirm`` hits in a row, off after ``release`` misses."""
    hit = F.col(detected)
    out = streaks(chunked(seq, size=size), key, {"_on": hit, "_off": ~hit})
    switch = F.when(F.col("_on") >= confirm, F.lit(True)).when(F.col("_off") >= release, F.lit(False))
    out = running(out, key, {"state": ("last", switch)}, size=size)
    return out.withColumn("state", F.coalesce("state", F.lit(False))).drop("_on", "_off", CHUNK, CORE)


def smooth(seq: DataFrame, key: Sequence[str], value: Column, alpha: float, name: str, seed: bool) -> DataFrame:
    """Exponential mean; ``seed`` starts from the first value, otherwise from zero."""
    first = F.col(POS) == 0 if seed else F.lit(False)
    gain = F.when(first, F.lit(0.0)).otherwise(F.lit(1.0 - alpha))
    drive = F.when(first, value).otherwise(value * alpha)
    return recurrence(seq, key, name, gain, drive)


def ema_residual(seq: DataFrame, key: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Sample minus the prediction before it; the first sample gives zero."""
    alpha = min(max(alpha, 0.001), 0.999)
    out = smooth(seq, key, F.col(value), alpha, "_ema", seed=True)
    # ema = (1 - a) * previous + a * x, hence x - previous = (x - ema) / (1 - a).
    residual = (F.col(value) - F.col("_ema")) / (1.0 - alpha)
    return out.withColumn("residual", F.when(F.col(POS) == 0, F.lit(0.0)).otherwise(residual)).drop("_ema")


def gate(
    seq: DataFrame, key: Sequence[str], score: str, novelty: str, drift: str, size: int | None = None
) -> DataFrame:
    """Coherence gate with its low-coherence counter.

    The counter is the number of counted observations since the last accepted one,
    and once it has reached the limit the gate stays in ``recalibrate``: both are
    running aggregates.
    """
    s, n, d = F.col(score), F.col(novelty), F.col(drift)
    accept = sc.gate_counts(n, d) & sc.gate_accepts(s, n, d)
    counted = sc.gate_counts(n, d) & ~sc.gate_accepts(s, n, d)
    limit = sc.GATE["max_stale"]
    out = chunked(seq, size=size).withColumn("_acc", accept).withColumn("_cnt", counted.cast("bigint"))
    out = running(out, key, {"_low": ("sum", F.col("_cnt"))}, size=size)
    reset = F.when(F.col("_acc"), F.col("_low"))
    out = running(out, key, {"_base": ("last", reset)}, size=size, exclusive=True)
    prior = F.col("_low") - F.col("_cnt") - F.coalesce("_base", F.lit(0))
    out = out.withColumn("_prior", prior)
    out = running(out, key, {"_latch": ("max", (F.col("_prior") >= limit).cast("int"))}, size=size)
    stale = F.when(F.col("_latch") == 1, F.lit(limit)).otherwise(F.col("_prior"))
    out = out.withColumn("stale_frames", stale.cast("bigint"))
    out = out.withColumn("action", sc.gate_decision(s, n, d, F.col("stale_frames")))
    return out.drop("_acc", "_cnt", "_low", "_base", "_prior", "_latch", CHUNK, CORE)


def intention(seq: DataFrame, key: Sequence[str], slope: str, energy: str, lead: str) -> DataFrame:
    """Lead-feature score, sustained count and label per frame."""
    e, sl = F.col(energy), F.col(slope)
    out = seq.withColumn("score", sc.intention_score(sl, e, F.col(lead)))
    moving = e >= 0.45
    out = streaks(out, key, {"sustained": (F.col("score") >= 0.62) & ~moving})
    likely = (F.col("sustained") >= 3) & (F.col("score") >= 0.62)
    label = (
        F.when(moving, "motion")
        .when(likely, "likely")
        .when(F.col("score") >= 0.38, "preparing")
        .otherwise("none")
    )
    return out.withColumn("label", label)


def trend(daily: DataFrame, key: Sequence[str], day: str, value: str, points: int | None = None) -> DataFrame:
    """Summary of a metric over all days of a key, with the slope per day; ``points`` asks for the latest days only.

    ``daily`` has one row per key and day, so a key is bounded by the calendar.
    """
    rows = daily
    if points is not None:
        recent = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(day)))
        rows = daily.withColumn("_r", recent).filter(F.col("_r") <= points)
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(value, day).alias("latest"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.coalesce(F.regr_slope(F.col(value), F.col(day).cast("double")), F.lit(0.0)).alias("slope"),
    )
    direction = (
        F.when(F.col("slope") > 1e-3, "increasing").when(F.col("slope") < -1e-3, "decreasing").otherwise("stable")
    )
    return out.withColumn("direction", direction)


def asof(
    left: DataFrame, right: DataFrame, key: Sequence[str], time: str, tie: Sequence[str], payload: Sequence[str]
) -> DataFrame:
    """Attach the latest ``right`` row at or before each ``left`` row.

    Both sides become one sequence and the last right-hand payload is carried
    forward, so the join never compares pairs and a hot key spreads over tasks.
    Rows at equal time put the right side first.
    """
    carried = F.struct(*payload)
    r = right.select(*key, time, *tie, F.lit(0).alias("_side"), carried.alias("_match"))
    extra = [c for c in left.columns if c not in key and c != time and c not in tie]
    frames = left.select(*key, time, *tie, F.lit(1).alias("_side"), *extra)
    both = frames.unionByName(r, allowMissingColumns=True)
    seq = sequence(both, key, [time, "_side", *tie])
    out = running(seq, key, {"_found": ("last", F.col("_match"))}).filter("_side = 1")
    return out.select(
        *key, time, *tie, *extra, *[F.col(f"_found.{c}").alias(f"match_{c}") for c in payload]
    )


def state_changes(seq: DataFrame, key: Sequence[str], state: str, attributes: str, at: str) -> DataFrame:
    """Published changes only: rows whose state or attributes differ from the row before.

    ``last_changed`` moves only when the state itself does.
    """
    out = framed(
        seq,
        key,
        {
            "old_state": lambda w: F.lag(state).over(w),
            "_old_attr": lambda w: F.lag(attributes).over(w),
        },
        before=1,
    )
    first = F.col(POS) == 0
    moved = first | ~F.col(state).eqNullSafe(F.col("old_state"))
    out = out.withColumn("_moved", moved)
    out = running(out, key, {"last_changed": ("last", F.when(F.col("_moved"), F.col(at)))})
    publish = F.col("_moved") | ~F.col(attributes).eqNullSafe(F.col("_old_attr"))
    return out.filter(publish).drop("_moved", "_old_attr")
