"""Spectra of bounded windows.

Windows are count-based, so an array holds one window and never grows with the
data. Only the FFT itself runs in NumPy, on whole Arrow batches of equally long
windows; peak search, interpolation and confidences are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleframe.functions import scoring as sc
from rippleframe.functions.vectors import let, total
from rippleframe.operators.windows import median_of

TAPERS = {"hann": np.hanning, "blackman": np.blackman, "none": np.ones}
DOUBLES = T.ArrayType(T.DoubleType())


def _by_length(series: pd.Series, apply) -> pd.Series:
    """Run ``apply`` on one matrix per distinct array length."""
    lengths = series.map(len)
    rows = {}
    for n, idx in lengths.groupby(lengths).groups.items():
        if n:
            rows.update(zip(idx, apply(np.stack(series.loc[idx].to_numpy()).astype(np.float64))))
    return pd.Series([rows.get(i) for i in series.index], index=series.index, dtype=object)


def spectrum_amplitude(samples: Column | str, taper: str = "hann") -> Column:
    """|rfft| of the mean-removed, tapered, zero-padded window; the DC bin is zero."""

    @F.pandas_udf(DOUBLES)
    def run(series: pd.Series) -> pd.Series:
        def fft(x):
            n = x.shape[1]
            size = 1 << (max(n, 4) - 1).bit_length()
            x = (x - x.mean(axis=1, keepdims=True)) * (TAPERS[taper](n) if n > 1 else 1.0)
            a = np.abs(np.fft.rfft(x, size, axis=1))
            a[:, 0] = 0.0
            return a

        return _by_length(series, fft)

    return run(samples)


def bandpass(samples: Column | str, rate: float, low: float, high: float) -> Column:
    """Brick-wall band-pass of the mean-removed window."""

    @F.pandas_udf(DOUBLES)
    def run(series: pd.Series) -> pd.Series:
        def cut(x):
            n = x.shape[1]
            if n < 3:
                return x
            f = np.fft.rfftfreq(n, d=1.0 / rate)
            z = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)
            z[:, (f < low) | (f > min(high, rate / 2))] = 0.0
            return np.fft.irfft(z, n=n, axis=1)

        return _by_length(series, cut)

    return run(samples)


def high_pass(samples: Column | str, rate: float, cutoff: float) -> Column:
    """First-order high-pass along each window."""
    rc, dt = 1.0 / (2.0 * np.pi * cutoff), 1.0 / rate
    alpha = rc / (rc + dt)

    @F.pandas_udf(DOUBLES)
    def run(series: pd.Series) -> pd.Series:
        def scan(x):
            y = np.empty_like(x)
            y[:, 0] = x[:, 0]
            for i in range(1, x.shape[1]):
                y[:, i] = alpha * (y[:, i - 1] + x[:, i] - x[:, i - 1])
            return y

        return _by_length(series, scan)

    return run(samples)


def notch(samples: Column | str, centre: Column | str, rate: float, bandwidth: float = 0.05) -> Column:
    """Second-order notch at a per-row frequency; a frequency outside (0, rate/2) is a no-op."""

    @F.pandas_udf(DOUBLES)
    def run(series: pd.Series, freq: pd.Series) -> pd.Series:
        r = 1.0 - np.pi * bandwidth / rate
        out = []
        for x, f in zip(series, freq):
            x = np.asarray(x, dtype=np.float64)
            if not 0.0 < f < rate / 2:
                out.append(x)
                continue
            c = np.cos(2.0 * np.pi * f / rate)
            y, x1, x2, y1, y2 = np.empty_like(x), 0.0, 0.0, 0.0, 0.0
            for i, v in enumerate(x):
                w = v - 2 * c * x1 + x2 + 2 * r * c * y1 - r * r * y2
                y[i], x2, x1, y2, y1 = w, x1, v, y1, w
            out.append(y)
        return pd.Series(out)

    return run(samples, centre)


def impulse_response(re: Column | str, im: Column | str, bins: int) -> Column:
    """Magnitudes of the impulse response of centred subcarriers on a ``bins`` grid.

    Negative subcarriers wrap to the end of the grid, there is no DC subcarrier,
    and the transform is scaled by bins over the window sum (Hann over the
    subcarriers).
    """

    @F.pandas_udf(DOUBLES)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        re_, im_ = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
        n = re_.shape[1]
        taper = np.hanning(n)
        index = np.concatenate([np.arange(-(n // 2), 0), np.arange(1, n - n // 2 + 1)]) % bins
        grid = np.zeros((len(a), bins), dtype=complex)
        grid[:, index] = (re_ + 1j * im_) * taper
        taps = np.abs(np.fft.ifft(grid, axis=1)) * bins / taper.sum()
        return pd.Series(list(taps))

    return run(re, im)


def band_peak(amplitude: Column | str, rate: float, n_fft: int, low: float, high: float, power: bool) -> Column:
    """Struct describing the strongest bin between ``low`` and ``high`` hertz.

    ``power`` interpolates the peak on power, otherwise on amplitude.
    """
    a = F.col(amplitude) if isinstance(amplitude, str) else amplitude
    df = rate / n_fft
    lo = int(np.ceil(low / df - 1e-9))
    hi = int(np.floor(min(high, rate / 2) / df + 1e-9))

    def describe(b):
        p, band, top, k = b["p"], b["band"], b["top"], b["k"]
        curve = p if power else b["a"]
        left, mid, right = F.get(curve, k - 1), F.get(curve, k), F.get(curve, k + 1)
        bend = left - 2 * mid + right
        shift = F.when((k <= 0) | right.isNull() | (F.abs(bend) <= 1e-20), F.lit(0.0)).otherwise(
            0.5 * (left - right) / bend
        )
        below = F.filter(band, lambda x: x < top)
        background = let(
            below, lambda v: F.when(F.size(v) > 0, median_of(v)).otherwise(total(band) / F.size(band))
        )
        return F.struct(
            k.alias("bin"),
            shift.alias("shift"),
            top.alias("power"),
            total(band).alias("band_power"),
            total(p).alias("total_power"),
            (top / F.greatest(background, F.lit(1e-20))).alias("prominence"),
            ((left < mid) & (right < mid)).alias("local_max"),
        )

    def locate(s):
        band = F.slice(s["p"], lo + 1, hi - lo + 1)
        return let(
            F.struct(s["a"].alias("a"), s["p"].alias("p"), band.alias("band"), F.array_max(band).alias("top")),
            lambda b: let(
                F.struct(
                    b["a"].alias("a"), b["p"].alias("p"), b["band"].alias("band"), b["top"].alias("top"),
                    (F.array_position(b["band"], b["top"]).cast("int") - 1 + lo).alias("k"),
                ),
                describe,
            ),
        )

    return let(F.struct(a.alias("a"), F.transform(a, lambda x: x * x).alias("p")), locate)


def vital_estimate(peak: Column, rate: float, n_fft: int, low: float, high: float, seconds: float, needed: float):
    """Columns bpm, confidence and status of a vital sign from its band peak."""
    df = rate / n_fft
    hz = (peak["bin"] + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), peak["shift"]))) * df
    hz = F.greatest(F.lit(low), F.least(F.lit(high), hz))
    share = sc.clamp01_or_zero(peak["band_power"] / peak["total_power"])
    prominence = sc.clamp01_or_zero((F.log2(F.greatest(peak["prominence"], F.lit(1.0))) - 0.25) / 3.0)
    energy = sc.clamp01_or_zero(share / 0.35)
    support = sc.clamp01_or_zero(share / 0.25)
    duration = min(seconds / needed, 1.0) if seconds >= needed else 0.0
    usable = (peak["total_power"] > 1e-20) & (peak["band_power"] > 1e-20) & F.lit(duration > 0)
    confidence = sc.clamp01_or_zero(duration * (0.65 * prominence + 0.35 * energy) * support)
    confidence = F.when(usable, confidence).otherwise(F.lit(0.0))
    return {
        "bpm": F.when(usable, hz * 60.0),
        "confidence": confidence,
        "status": sc.confidence_status(confidence),
    }


def rescue_peak(peak: Column, amplitude: Column | str, rate: float, n_fft: int, gain: float):
    """Columns bpm, amplitude, regularity and confidence of the rescue detectors.

    ``gain`` is half the taper sum. Second and third harmonics count half.
    """
    a = F.col(amplitude) if isinstance(amplitude, str) else amplitude
    df = rate / n_fft
    hz = F.greatest((peak["bin"] + peak["shift"]) * df, F.lit(0.0))

    def harmonic(m):
        at = F.round(hz * m / df).cast("int")
        x = F.coalesce(F.get(a, at), F.lit(0.0))
        return F.when(hz * m <= rate / 2, x * x).otherwise(F.lit(0.0))

    regular = sc.clamp01_or_zero(
        (peak["power"] + 0.5 * (harmonic(2) + harmonic(3))) / peak["total_power"] * 3.0
    )
    height = F.sqrt(peak["power"]) / gain
    return {
        "bpm": hz * 60.0,
        "amplitude": height,
        "regularity": regular,
        "confidence": sc.clamp01_or_zero(F.least(height, F.lit(1.0)) * 0.4 + regular * 0.6),
    }


def breathing_type(bpm: Column, regularity: Column) -> Column:
    return (
        F.when((bpm < 6) & (regularity < 0.3), "agonal")
        .when(bpm < 10, "shallow")
        .when(bpm > 30, "labored")
        .when(regularity < 0.4, "irregular")
        .otherwise("normal")
    )


def largest_step(samples: Column | str) -> Column:
    """Largest difference of neighbouring samples; 0 for a single one."""
    x = F.col(samples) if isinstance(samples, str) else samples
    n = F.size(x)
    steps = F.zip_with(F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: F.abs(b - a))
    return F.coalesce(F.array_max(steps), F.lit(0.0))


def periodicity(samples: Column | str) -> Column:
    """Largest normalised autocorrelation over lags 1 .. n/2 - 1, at least 0."""
    x = F.col(samples) if isinstance(samples, str) else samples

    def best(s):
        c, energy = s["c"], s["e"]

        def at(lag):
            head = F.slice(c, 1, F.greatest(F.size(c) - lag, F.lit(0)))
            tail = F.slice(c, lag + 1, F.greatest(F.size(c) - lag, F.lit(0)))
            return total(F.zip_with(head, tail, lambda a, b: a * b)) / energy

        # At least one lag, so that the sequence never counts down; short windows give 0 below.
        lags = F.sequence(F.lit(1), F.greatest(F.floor(F.size(c) / 2).cast("int") - 1, F.lit(1)))
        return F.when((F.size(c) < 4) | (energy <= 1e-18), F.lit(0.0)).otherwise(
            sc.clamp01_or_zero(F.array_max(F.transform(lags, at)))
        )

    centred = let(total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
    return let(
        centred, lambda c: let(F.struct(c.alias("c"), total(F.transform(c, lambda v: v * v)).alias("e")), best)
    )


def movement(variance: Column, jump: Column, periodic: Column) -> Column:
    """Movement class; thresholds .1 / .5 / .3."""
    return (
        F.when((variance < 0.05) & (jump < 0.1), "none")
        .when((jump > 0.5) & (variance > 0.1), "gross")
        .when((periodic > 0.3) & (variance < 0.2), "periodic")
        .when(periodic > 0.3, "tremor")
        .when(variance > 0.05, "fine")
        .otherwise("none")
    )


def movement_intensity(variance: Column, jump: Column) -> Column:
    return sc.clamp01_or_zero(F.least(variance, F.lit(1.0)) * 0.6 + F.least(jump / 0.5, F.lit(1.0)) * 0.4)
