"""Per-subcarrier baselines and deviations of frames from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions import phase as ph
from rippleframe.functions.vectors import let
from rippleframe.operators.windows import median_of

MIN_FRAMES = 600
MIN_STD = 1e-6


def record(cells: DataFrame, subcarrier: str, amplitude: str, phase: str, min_frames: int = MIN_FRAMES, empty: Column | None = None) -> DataFrame:
    """Baseline per subcarrier; ``ready`` says whether there were enough frames.

    ``empty`` marks the cells of the empty room; all are, if it is not given. ``occupied`` counts the others.
    """
    counts = F.lit(True) if empty is None else F.coalesce(empty, F.lit(False))
    s, c, n = F.sum(F.when(counts, F.sin(phase))), F.sum(F.when(counts, F.cos(phase))), F.count(F.when(counts, 1))
    a = F.when(counts, F.col(amplitude))
    spread = 1 - F.least(F.try_divide(F.hypot(s, c), n), F.lit(1.0))
    return cells.groupBy(subcarrier).agg(
        F.avg(a).alias("amplitude_mean"), F.coalesce(F.var_samp(a), F.lit(0.0)).alias("amplitude_variance"),
        F.atan2(s, c).alias("phase_mean"), F.when(n > 0, spread).alias("phase_dispersion"),
        n.alias("frames"), (n >= min_frames).alias("ready"), F.count(F.when(~counts, 1)).alias("occupied"),
    )


def deviation(frames: DataFrame, baseline: DataFrame, subcarrier: str, amplitude: Column, phase: Column) -> DataFrame:
    """Median and maximum |z|, median phase drift and flags per frame.

    The baseline, one entry per subcarrier, becomes one array through a scalar
    subquery; frames stay arrays and are never exploded.
    """
    fields = ["amplitude_mean", "amplitude_variance", "phase_mean"]
    packed = baseline.agg(F.sort_array(F.collect_list(F.struct(subcarrier, *fields))).alias("_base"))
    rows = frames.withColumns({"_a": amplitude, "_p": phase, "_base": packed.scalar()})
    floor = F.lit(MIN_STD**2)
    z = F.zip_with("_a", "_base", lambda a, b: F.abs(a - b["amplitude_mean"]) / F.sqrt(F.greatest(b["amplitude_variance"], floor)))
    drift = F.zip_with("_p", "_base", lambda p, b: ph.circular_distance(p, b["phase_mean"]))
    stats = let(z, lambda v: F.struct(median_of(v).alias("z_median"), F.array_max(v).alias("z_max")))
    rows = rows.withColumn("_z", stats).withColumn("phase_drift", median_of(drift))
    zm, d = F.col("_z.z_median"), F.col("phase_drift")
    moved, drifted = (zm > 2.0) | (d > math.pi / 6), (zm > 4.0) | (d > math.pi / 3)
    reason = F.when(drifted, "drift threshold exceeded").when(moved, "motion or person-like deviation detected").otherwise("within empty-room baseline")
    return rows.select(*frames.columns, zm.alias("z_median"), F.col("_z.z_max").alias("z_max"), d.alias("phase_drift"), moved.alias("motion"), drifted.alias("drift"), reason.alias("reason"))
