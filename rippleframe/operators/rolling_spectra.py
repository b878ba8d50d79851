"""Spectra over overlapping windows of long series: rolling rates and averaged power spectra.

A series is cut into chunks of consecutive samples with the samples before them repeated, so a
window is made where it ends and no task holds a whole key. Spectra of a key are
averaged as grouped means, which combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions import scoring as sc
from rippleframe.functions.vectors import let, var_pop
from rippleframe.operators import sequence as seqs
from rippleframe.operators import spectral as spec
from rippleframe.operators.sequence import CHUNK, CORE, POS, chunked
from rippleframe.operators.windows import median_of
from rippleframe.session import durable

CHUNK_SAMPLES = 65_536
#: Estimates of a key over which a rate is smoothed.
SMOOTHED = 3


def trailing_arrays(seq: DataFrame, key: Sequence[str], value: str, rows: int, step: int, first: int | None = None, short: bool = False) -> DataFrame:
    """key, pos and samples: the last ``rows`` values at every ``step``-th row from the ``first`` (``rows`` by default) on.

    The first windows may be shorter than ``rows``. Null and non-finite values are left out of a window. With
    ``short`` a key of fewer than ``first`` rows gets one window, of all its rows.
    """
    key, first = list(key), first or rows

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        pos, core = table.column(POS).to_numpy(), table.column(CORE).to_numpy(zero_copy_only=False)
        x = table.column(value).to_numpy(zero_copy_only=False).astype(np.float64)
        ends = core & (pos + 1 >= first) & ((pos + 1 - first) % step == 0)
        if short and core[-1] and pos[-1] + 1 < first:
            ends[-1] = True
        at = np.flatnonzero(ends)
        windows = [w[np.isfinite(w)] for w in (x[max(0, i - rows + 1) : i + 1] for i in at)]
        offsets = np.cumsum([0, *map(len, windows)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0), *windows])))
        own = table.take(pa.array(at))
        return pa.table({**{c: own.column(c) for c in key}, POS: own.column(POS), "samples": lists})

    kinds = {f.name: f.dataType.simpleString() for f in seq.schema.fields}
    cut = chunked(seq.select(*key, POS, F.col(value).cast("double").alias(value)), before=rows - 1, size=max(CHUNK_SAMPLES, rows))
    return cut.groupBy(*key, CHUNK).applyInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in key] + [f"{POS} bigint", "samples array<double>"]))


def rolling_rates(
    seq: DataFrame, key: Sequence[str], value: str, rate: float, low: float, high: float, rows: int, step: int, first: int, carriers: Column | None = None
) -> DataFrame:
    """key, pos, n, bpm, confidence, status and smoothed_bpm of every window of the last ``rows`` samples.

    Estimates start at the ``first`` usable length and follow every ``step`` samples. A window without a peak, too
    short after its gaps, or too flat is unavailable: its bpm is null and smoothing passes over it. The
    smoothed rate is the median of the last three available ones of the key. ``carriers`` is
    the share (0 to 1) of the subcarriers needed that the key has; it scales the confidence.
    """
    key = list(key)
    rows_at = trailing_arrays(seq, key, value, rows, step, first).withColumn("n", F.size("samples"))
    rows_at = rows_at.withColumn("a", spec.spectrum_amplitude("samples"))
    sizes = sorted({1 << (max(n, 4) - 1).bit_length() for n in range(first, rows + 1)})
    fft = 2 * (F.size("a") - 1)
    # A transform has a power of two points, so a handful of forms covers all lengths.
    estimates = [spec.vital_estimate(F.col(f"p{size}"), rate, size, low, high, 1.0, 1.0) for size in sizes]
    rows_at = rows_at.select("*", *[F.when(fft == size, spec.band_peak("a", rate, size, low, high, power=True)).alias(f"p{size}") for size in sizes])
    usable = (F.col("n") >= first) & (var_pop("samples") >= 1e-14)
    pick = {name: F.coalesce(*[F.when(fft == size, e[name]) for size, e in zip(sizes, estimates)]) for name in ("bpm", "confidence")}
    confidence = sc.clamp01_or_zero(pick["confidence"] * (F.lit(1.0) if carriers is None else sc.clamp01_or_zero(carriers)))
    out = rows_at.select(*key, POS, F.col("n").cast("bigint").alias("n"), F.when(usable, pick["bpm"]).alias("bpm"), F.when(usable, confidence).otherwise(F.lit(0.0)).alias("confidence"))
    status = F.when(F.col("bpm").isNull(), F.lit("unavailable")).otherwise(sc.confidence_status(F.col("confidence")))
    out = out.withColumn("status", status)
    out = out.withColumn("bpm", F.when(F.col("status") != "unavailable", F.col("bpm")))
    out = durable(out, "rates")  # read twice below; the transforms run once
    there = seqs.sequence(out.where(F.col("bpm").isNotNull()).withColumnRenamed(POS, "at"), key, ["at"])
    last = seqs.framed(there, key, {"_last": lambda w: F.collect_list("bpm").over(w.rowsBetween(1 - SMOOTHED, 0))}, before=SMOOTHED - 1)
    smooth = last.select(*key, F.col("at").alias(POS), median_of(F.col("_last")).alias("smoothed_bpm"))
    return seqs.attach(out, smooth, [*key, POS])


def power_spectrum(samples: Column | str, rate: float) -> Column:
    """Power per hertz of each bin of the mean-removed, Hann-tapered window, without padding."""

    @F.pandas_udf(spec.DOUBLES)
    def run(series: pd.Series) -> pd.Series:
        def power(x):
            taper = np.hanning(x.shape[1]) if x.shape[1] > 1 else np.ones(1)
            x = (x - x.mean(axis=1, keepdims=True)) * taper
            return np.abs(np.fft.rfft(x, axis=1)) ** 2 / max(rate * float(np.sum(taper**2)), 1e-15)

        return spec._by_length(series, power)

    return run(samples)


def welch(seq: DataFrame, key: Sequence[str], value: str, rate: float, segment: int) -> DataFrame:
    """key, segments, hz and psd of every bin: power spectra averaged over segments that overlap by half.

    A key shorter than a segment is one segment of its own length, with its own bins. What follows the last
    whole segment of a longer key adds nothing. A key without finite samples has no rows.
    """
    parts = trailing_arrays(seq, key, value, segment, max(segment // 2, 1), short=True)
    parts = parts.withColumn("n", F.size("samples")).where("n > 0").withColumn("p", power_spectrum("samples", rate))
    bins = parts.select(*key, "n", F.posexplode("p").alias("k", "p"))
    out = bins.groupBy(*key, "n", "k").agg(F.count(F.lit(1)).alias("segments"), F.avg("p").alias("psd"))
    return out.select(*key, "n", "segments", (F.col("k") * rate / F.col("n")).alias("hz"), "psd")


def spectrum_peak(spectrum: DataFrame, key: Sequence[str], low: float, high: float) -> DataFrame:
    """key, hz, peak_ratio, energy_share and confidence of the strongest bin between ``low`` and ``high`` hertz.

    Of equal bins the lowest counts. A key without a bin in the band has null hz and confidence 0. Bins are evenly
    spaced, so shares of the area under the spectrum are sums by trapezoids.
    """
    key = list(key)
    inside = (F.col("hz") >= low) & (F.col("hz") <= high)
    band = F.when(inside, F.col("psd"))
    out = spectrum.groupBy(*key).agg(
        F.max(F.when(inside, F.struct("psd", (-F.col("hz")).alias("neg")))).alias("top"), F.avg(band).alias("mean"), F.count(band).alias("n"), F.sum(band).alias("inner"),
        F.min_by("psd", F.when(inside, F.col("hz"))).alias("left"), F.max_by("psd", F.when(inside, F.col("hz"))).alias("right"),
        F.sum("psd").alias("total"), F.min_by("psd", "hz").alias("first"), F.max_by("psd", "hz").alias("last"), (F.max("hz") / (F.count(F.lit(1)) - 1)).alias("width"),
    )
    whole = (F.col("total") - (F.col("first") + F.col("last")) / 2) * F.col("width") + 1e-18
    part = F.when(F.col("n") > 1, (F.col("inner") - (F.col("left") + F.col("right")) / 2) * F.col("width")).otherwise(F.col("inner"))
    ratio = F.col("top.psd") / (F.col("mean") + 1e-18)
    out = out.select(*key, (-F.col("top.neg")).alias("hz"), ratio.alias("peak_ratio"), sc.clamp01_or_zero(part / whole).alias("energy_share"))
    confidence = let(sc.clamp01_or_zero((F.col("peak_ratio") - 1.0) / 5.0), lambda p: sc.clamp01_or_zero(0.65 * p + 0.35 * F.col("energy_share")))
    return out.withColumn("confidence", F.coalesce(confidence, F.lit(0.0)))
