"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.operators.sequence import POS, attach, sequence


def quantiles(
    df: DataFrame, key: Sequence[str], value: str, tie: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per key, by rank.

    The exact ``percentile`` aggregate keeps every distinct value of a group in one
    hash map. Here the values are ranked by a range sort, and only the one or two
    rows next to each requested rank are kept.
    """
    key = list(key)
    seq = sequence(df.select(*key, value, *tie).filter(F.col(value).isNotNull()), key, [value, *tie])
    rows = attach(seq, seq.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key)
    target = {n: (F.col("_n") - 1) * F.lit(p) for n, p in probs.items()}
    near = F.lit(False)
    for t in target.values():
        near = near | (F.col(POS) == F.floor(t)) | (F.col(POS) == F.ceil(t))
    rows = rows.filter(near)

    def at(t):
        low = F.max(F.when(F.col(POS) == F.floor(t), F.col(value)))
        high = F.max(F.when(F.col(POS) == F.ceil(t), F.col(value)))
        part = F.max(t - F.floor(t))
        return low + (high - low) * part

    return rows.groupBy(*key).agg(*[at(t).alias(n) for n, t in target.items()])
