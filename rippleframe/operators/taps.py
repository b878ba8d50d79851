"""Sparse taps of an impulse response (one array per frame)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippleframe.functions.vectors import col, let, total
from rippleframe.operators.windows import median_of


def noise_floor(mags: Column | str) -> Column:
    return let(
        median_of(col(mags)),
        lambda m: m + 1.4826 * median_of(F.transform(col(mags), lambda x: F.abs(x - m))),
    )


def threshold(mags: Column | str, ratio: float = 0.05, floor: Column | None = None, multiplier: float | None = None) -> Column:
    dominant = F.array_max(col(mags)) * ratio
    return dominant if multiplier is None else F.greatest(dominant, floor * multiplier)


def sparse_taps(mags: Column | str, minimum: Column, top_k: int, separation: int = 0) -> Column:
    """Strongest bins at or above ``minimum``, at least ``separation`` + 1 bins apart."""
    pairs = F.transform(col(mags), lambda x, i: F.struct((-x).alias("neg"), i.alias("bin")))
    ordered = F.array_sort(F.filter(pairs, lambda p: -p["neg"] >= minimum))
    if separation > 0:
        empty = F.slice(ordered, 1, 0)
        ordered = F.aggregate(
            ordered,
            empty,
            lambda kept, p: F.when(
                F.forall(kept, lambda q: F.abs(q["bin"] - p["bin"]) > separation),
                F.concat(kept, F.array(p)),
            ).otherwise(kept),
        )
    return F.transform(F.slice(ordered, 1, top_k), lambda p: p["bin"])


def delay_spread(mags: Column | str, spacing: float = 1.0) -> Column:
    """Power-weighted deviation of the delay."""

    def spread(power):
        whole = total(power)
        centre = total(F.transform(power, lambda p, i: p * i)) / whole
        around = let(centre, lambda c: total(F.transform(power, lambda p, i: p * (i - c) * (i - c))))
        return F.when(whole <= 1e-24, F.lit(0.0)).otherwise(F.sqrt(F.greatest(around / whole, F.lit(0.0))) * spacing)

    return let(F.transform(col(mags), lambda x: x * x), spread)


def active_taps(mags: Column | str) -> Column:
    count = let(F.array_max(col(mags)), lambda top: F.size(F.filter(col(mags), lambda x: (x >= top * 0.01) & (top > 0))))
    return F.coalesce(count, F.lit(0))
