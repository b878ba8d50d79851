"""Windowed statistics, filters and reshaping of ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.functions import phase as ph
from rippleframe.functions import scoring as sc
from rippleframe.functions.vectors import let
from rippleframe.operators.sequence import POS, attach, framed, running

MAD_SCALE = 1.4826
GRID_BLOCK = 4096


def steps(seq: DataFrame, key: Sequence[str], value: str, name: str = "step") -> DataFrame:
    """Difference to the previous sample of the key; null on the first one."""
    return framed(seq, key, {name: lambda w: F.col(value) - F.lag(value).over(w)}, before=1)


def window_statistics(
    frames: DataFrame, group: Sequence[str], cell: Sequence[str], time: str, amplitude: str, phase: str
) -> DataFrame:
    """Six statistics per window of a dense [time, cell] block.

    ``group`` identifies a window of bounded length, so the inner window function
    sorts at most that many rows. Amplitude variance is over all samples
    (population); subcarrier variance is the mean sample variance of the cells.
    """
    w = W.partitionBy(*group, *cell).orderBy(time)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = F.coalesce(ph.unwrap_step(F.col(phase) - F.lag(phase).over(w)), F.col(phase))
    rows = frames.select(
        *group,
        *cell,
        F.col(time),
        F.col(amplitude).alias("_amp"),
        (F.col(amplitude) - F.lag(amplitude).over(w)).alias("_d"),
        turns.alias("_turn"),
    ).withColumn("_phase", F.sum("_turn").over(so_far))
    cells = rows.groupBy(*group, *cell).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_amp").alias("_m"),
        F.var_pop("_amp").alias("_v"),
        F.coalesce(F.var_samp("_amp"), F.lit(0.0)).alias("_vs"),
        F.coalesce(F.avg(F.abs("_d")), F.lit(0.0)).alias("_ad"),
        F.coalesce(F.avg(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("_dd"),
        F.var_pop("_phase").alias("_pv"),
    )
    return cells.groupBy(*group).agg(
        F.max("_n").alias("n_frames"),
        F.avg("_m").alias("mean_amplitude"),
        (F.avg("_v") + F.var_pop("_m")).alias("amplitude_variance"),
        F.avg("_ad").alias("temporal_delta"),
        F.avg("_dd").alias("motion_energy"),
        F.avg("_pv").alias("phase_variance"),
        F.avg("_vs").alias("subcarrier_variance"),
    )


def _stats(prefix: str = "") -> dict[str, Column]:
    return {
        "delta": F.col(f"{prefix}temporal_delta"),
        "amplitude": F.col(f"{prefix}amplitude_variance"),
        "phase": F.col(f"{prefix}phase_variance"),
        "subcarrier": F.col(f"{prefix}subcarrier_variance"),
        "mean": F.col(f"{prefix}mean_amplitude"),
    }


def score_windows(stats: DataFrame, baseline_prefix: str | None = None) -> DataFrame:
    """Motion and presence scores; relative to ``<prefix>*`` columns when given."""
    reference = _stats(baseline_prefix) if baseline_prefix else None
    parts = sc.motion_components(_stats(), reference)
    out = stats.select("*", *[c.alias(f"{k}_component") for k, c in parts.items()])
    parts = {k: F.col(f"{k}_component") for k in parts}
    out = out.withColumn("motion_score", sc.motion_total(parts))
    out = out.withColumn(
        "presence_score",
        sc.presence_score(
            F.col("mean_amplitude"),
            F.col("amplitude_variance"),
            F.col("motion_score"),
            F.col("subcarrier_component"),
            reference,
        ),
    )
    return out.withColumn("state", sc.presence_state(F.col("presence_score"), F.col("motion_score")))


def rolling(seq: DataFrame, key: Sequence[str], value: str, rows: int) -> DataFrame:
    """Trailing mean and population variance over the last ``rows`` samples."""
    over = lambda w: w.rowsBetween(1 - rows, 0)
    return framed(
        seq,
        key,
        {
            "rolling_mean": lambda w: F.avg(value).over(over(w)),
            "rolling_var": lambda w: F.var_pop(value).over(over(w)),
        },
        before=rows - 1,
    )


def median_of(values: Column) -> Column:
    """Median of a (short) array."""
    return let(
        F.sort_array(values),
        lambda s: (
            F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))
        )
        / 2,
    )


def hampel(
    seq: DataFrame, key: Sequence[str], value: str, half_window: int = 3, threshold: float = 3.0
) -> DataFrame:
    """Replace outliers by the local median; edges use the truncated neighbourhood."""
    around = lambda w: w.rowsBetween(-half_window, half_window)
    out = framed(
        seq,
        key,
        {"_near": lambda w: F.collect_list(value).over(around(w))},
        before=half_window,
        after=half_window,
    )
    out = out.withColumn("median", median_of(F.col("_near")))
    spread = median_of(F.transform("_near", lambda x: F.abs(x - F.col("median"))))
    deviation = F.abs(F.col(value) - F.col("median"))
    out = out.withColumn("sigma", MAD_SCALE * spread)
    limit = F.when(F.col("sigma") > 1e-15, threshold * F.col("sigma")).otherwise(F.lit(1e-15))
    out = out.withColumn("is_outlier", deviation > limit)
    return out.withColumn(
        "filtered", F.when(F.col("is_outlier"), F.col("median")).otherwise(F.col(value))
    ).drop("_near")


def per_key(df: DataFrame, key: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach key-level aggregates to every row.

    A grouped aggregate combines map-side, so a hot key sends one row per task.
    The join back broadcasts the aggregate only when its measured size allows,
    and is otherwise a sort-merge join that AQE splits on skew.
    """
    return attach(df, df.groupBy(*key).agg(*aggs), list(key))


def zscore(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    out = per_key(df, key, F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return out.withColumn("z", z).drop("_m", "_s")


def min_max(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    out = per_key(df, key, F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    x = F.when(span > 0, (F.col(value) - F.col("_lo")) / span).otherwise(F.lit(0.0))
    return out.withColumn("scaled", x).drop("_lo", "_hi")


def change_points(seq: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Steps whose size exceeds mean + 2 population deviations; needs three samples."""
    size = F.abs(F.col("step"))
    jumps = steps(seq, key, value).withColumn("_size", size)
    jumps = per_key(
        jumps,
        key,
        F.count(F.lit(1)).alias("n_samples"),
        (F.avg("_size") + 2 * F.stddev_pop("_size")).alias("limit"),
    )
    return jumps.groupBy(*key).agg(
        F.first("n_samples").alias("n_samples"),
        F.count_if((F.col("n_samples") >= 3) & (F.col("_size") > F.col("limit"))).alias("change_points"),
    )


def unwrap(seq: DataFrame, key: Sequence[str], phase: str) -> DataFrame:
    """Phase with whole turns removed, along the whole key."""
    out = steps(seq, key, phase, "_d")
    turn = F.coalesce(ph.unwrap_step(F.col("_d")), F.col(phase))
    return running(out, key, {"unwrapped": ("sum", turn)}).drop("_d")


def tumbling(seq: DataFrame, rows: int, name: str = "win") -> DataFrame:
    """Consecutive count windows of ``rows`` samples."""
    return seq.withColumn(name, F.floor(F.col(POS) / rows))


def sliding(seq: DataFrame, rows: int, step: int, name: str = "win") -> DataFrame:
    """Overlapping count windows: window ``i`` covers positions [i*step, i*step + rows)."""
    first = F.greatest(F.lit(0), F.ceil((F.col(POS) - (rows - 1)) / step))
    return seq.withColumn(name, F.explode(F.sequence(first, F.floor(F.col(POS) / step))))


def window_arrays(seq: DataFrame, group: Sequence[str], value: str, name: str = "samples") -> DataFrame:
    """One ordered array per window; ``group`` must bound the window length."""
    pairs = F.sort_array(F.collect_list(F.struct(POS, value)))
    return seq.groupBy(*group).agg(pairs.alias("_p")).select(
        *group, F.transform("_p", lambda p: p[value]).alias(name)
    )


def impute(df: DataFrame, key: Sequence[str], value: str, valid: Column) -> DataFrame:
    """Replace invalid cells by the mean of the valid ones of the key."""
    out = df.withColumn("_ok", F.when(valid, F.col(value)))
    out = per_key(out, key, F.avg("_ok").alias("_m"))
    return out.withColumn("imputed", F.coalesce("_ok", "_m")).drop("_ok", "_m")


def resample(seq: DataFrame, key: Sequence[str], time: str, value: str, period: int) -> DataFrame:
    """Linear interpolation onto multiples of ``period``.

    Each pair of neighbouring samples emits the grid points between them, so no
    as-of join is needed. Gaps of zero length are skipped. A long gap is expanded in
    blocks, so that no row holds all of its points.
    """
    out = framed(
        seq,
        key,
        {"_t0": lambda w: F.lag(time).over(w), "_v0": lambda w: F.lag(value).over(w)},
        before=1,
    ).filter(F.col(time) > F.col("_t0"))
    first, last = F.ceil(F.col("_t0") / period), F.ceil(F.col(time) / period) - 1
    points = out.filter(last >= first).select(
        *key, "_t0", "_v0", F.col(time).alias("_t1"), F.col(value).alias("_v1"), first.alias("_g0"), last.alias("_g1"),
        F.explode(F.sequence(F.floor(first / GRID_BLOCK), F.floor(last / GRID_BLOCK))).alias("_b"),
    )
    low = F.greatest(F.col("_g0"), F.col("_b") * GRID_BLOCK)
    high = F.least(F.col("_g1"), F.col("_b") * GRID_BLOCK + (GRID_BLOCK - 1))
    points = points.withColumn("grid", F.explode(F.sequence(low, high)))
    ratio = (F.col("grid") * period - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    return points.select(
        *key, "grid", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * ratio).alias("resampled")
    )


def gate_frames(
    frames: DataFrame, key: Sequence[str], energy: str, strength: float = 0.1, reach: int = 2, eps: float = 1e-7
) -> DataFrame:
    """Gain per spectrogram frame: strong frames lift themselves and their neighbours."""
    out = per_key(frames, key, F.min(energy).alias("_lo"), F.max(energy).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    flat = span <= eps
    out = out.withColumn("_e", F.when(flat, F.lit(0.0)).otherwise((F.col(energy) - F.col("_lo")) / span))
    strong = F.col("_e") >= max(strength, eps)

    def support(w):
        near = [F.when(F.col("_e") >= strength * 0.5, F.col("_e")).otherwise(F.lit(0.0))]
        for d in range(-reach, reach + 1):
            lift = F.when(strong, F.lit(1.0 - abs(d) / (reach + 1))).otherwise(F.lit(0.0))
            near.append(F.coalesce(F.lag(lift, d).over(w) if d else lift, F.lit(0.0)))
        return F.greatest(*near)

    out = framed(out, key, {"support": support}, before=reach, after=reach)
    low, high = max(eps, 1.0 - strength), 1.0 + strength
    gain = low + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("support")))
    gain = F.when(flat & (F.col("_hi") > eps), F.lit(1.0)).when(flat, F.lit(0.0)).otherwise(gain)
    return out.withColumn("gain", gain).drop("_lo", "_hi", "_e")


def largest_gap_split(scores: DataFrame, key: Sequence[str], index: str, score: str) -> DataFrame:
    """Split each key's scores at the largest gap; add side and importance weight.

    One key is one vector (one score per subcarrier), so its length is the vector
    width. Without a gap the halves by index are used; the side with the higher
    mean is the sensitive one.
    """
    ranked = W.partitionBy(*key).orderBy(score, index)
    whole = W.partitionBy(*key)
    out = scores.withColumn("_rank", F.row_number().over(ranked) - 1).withColumn(
        "_gap", F.coalesce(F.col(score) - F.lag(score).over(ranked), F.lit(0.0))
    )
    out = out.withColumn("_top", F.max("_gap").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    cut = F.min(F.when(F.col("_gap") == F.col("_top"), F.when(F.col("_rank") > 0, F.col("_rank")))).over(whole)
    byindex = F.row_number().over(W.partitionBy(*key).orderBy(index)) - 1
    # Side A: above the cut, or the first half by index when there is no gap.
    side_a = F.when(F.col("_top") > 1e-12, F.col("_rank") >= cut).otherwise(byindex < F.floor(F.col("_n") / 2))
    out = out.withColumn("_a", side_a)
    mean_a = F.avg(F.when(F.col("_a"), F.col(score))).over(whole)
    mean_b = F.avg(F.when(~F.col("_a"), F.col(score))).over(whole)
    a_first = F.coalesce(mean_a, F.lit(float("-inf"))) >= F.coalesce(mean_b, F.lit(float("-inf")))
    out = out.withColumn("sensitive", F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.col("_a") == a_first))
    lo, hi = F.min(score).over(whole), F.max(score).over(whole)
    scaled = F.when(hi - lo <= 1e-12, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo))
    weight = F.when(F.col("sensitive"), 1.0 + scaled).otherwise(F.lit(0.5))
    return out.withColumn("weight", weight).drop("_rank", "_gap", "_top", "_n", "_a")
