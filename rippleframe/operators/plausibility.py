"""Physical plausibility of consecutive frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions import phase as ph
from rippleframe.functions.vectors import top_indices
from rippleframe.operators.sequence import framed, running

# Fixed values of the checks.
MAX_RELATIVE_JUMP = 4.0
MAX_ABSOLUTE_JUMP = 5.0
MAX_PHASE_SPEED = 80.0
MIN_COHERENCE = 0.20
MAX_CONFLICT = 0.25
MIN_AMPLITUDE = 1e-6


def _finite(v: str) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def check(seq: DataFrame, key: Sequence[str], amplitude: str, phase: str, coherence: str, at_us: str) -> DataFrame:
    """Findings per frame against the previous finite frame of the key.

    A frame with a non-finite value is reported but never becomes the reference, so
    the finite frames are compared among themselves.
    """
    rows = seq.withColumn("finite", _finite(amplitude) & _finite(phase) & _finite(coherence))
    good = F.when(F.col("finite"), F.struct(F.col(amplitude).alias("a"), F.col(phase).alias("p"), F.col(at_us).alias("t")))
    rows = running(rows, key, {"_last": ("last", good)})
    rows = framed(rows, key, {"_prev": lambda w: F.lag("_last").over(w)}, before=1).drop("_last")
    a, prev = F.col(amplitude), F.col("_prev.a")
    diff = F.zip_with(a, prev, lambda x, y: F.abs(x - y))
    rel = F.zip_with(a, prev, lambda x, y: F.abs(x - y) / F.greatest(F.abs(y), F.lit(MIN_AMPLITUDE)))
    rows = rows.withColumn("max_relative", F.array_max(rel)).withColumn("max_absolute", F.array_max(diff))
    rows = rows.withColumn("worst", top_indices(rel, 8))
    seconds = (F.col(at_us) - F.col("_prev.t")) / 1_000_000
    speed = F.array_max(F.zip_with(F.col(phase), F.col("_prev.p"), ph.circular_distance)) / seconds
    rows = rows.withColumn("phase_speed", F.when(seconds > 0, speed))
    clash = F.zip_with(a, F.col(coherence), lambda x, c: ((x > MIN_AMPLITUDE) & (c < MIN_COHERENCE)).cast("double"))
    rows = rows.withColumn("conflict", F.aggregate(clash, F.lit(0.0), lambda acc, x: acc + x) / F.size(clash))
    ok = F.col("finite")
    found = F.array_compact(F.array(
        F.when(~ok, F.lit("non_finite")),
        F.when(ok & ((F.col("max_relative") > MAX_RELATIVE_JUMP) | (F.col("max_absolute") > MAX_ABSOLUTE_JUMP)), F.lit("amplitude_jump")),
        F.when(ok & (F.col("phase_speed") > MAX_PHASE_SPEED), F.lit("phase_velocity")),
        F.when(ok & (F.col("conflict") > MAX_CONFLICT), F.lit("coherence_conflict")),
    ))
    return rows.withColumn("findings", found).withColumn("valid", F.size("findings") == 0).drop("_prev")
