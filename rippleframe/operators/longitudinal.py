"""Drift monitor whose baseline leaves out the points it flags itself.

The decision feeds back into the baseline, so the points of one metric have to be
visited in order. The monitor therefore takes one value per key and day: a series
is bounded by the number of calendar days, whatever the number of raw samples. The
series of many keys advance together, one day at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the monitor.
MIN_BASELINE = 7
MIN_SUSTAINED = 3
DRIFT_Z = 2.0
ALERT_Z = 3.0
MIN_STD = 1e-6

#: Series that advance together.
BLOCK = 1024
OUT = "z array<double>, is_drift array<boolean>, sustained array<bigint>, severity array<string>"


def drift_scores(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """z, drift, sustained and severity of a [series, days] matrix; NaN marks a day without a value.

    Such a day has no z and neither extends nor ends a run of drifts.
    """
    here = ~np.isnan(x)
    # The first points always belong to the baseline, so sums around their mean keep their digits.
    lead = here & (here.cumsum(axis=1) <= MIN_BASELINE)
    centre = np.where(lead, x, 0.0).sum(axis=1) / np.maximum(lead.sum(axis=1), 1)
    offset = np.where(here, x - centre[:, None], 0.0)
    kept, z = np.zeros_like(here), np.zeros_like(offset)
    total = np.zeros((3, len(x)))  # number, sum and sum of squares of the baseline's offsets
    for day, value in enumerate(offset.T):
        number, first, second = total
        mean = first / np.maximum(number, 1)
        spread = np.sqrt(np.maximum(second - first * mean, 0.0) / np.maximum(number - 1, 1))
        z[:, day] = np.where(number >= MIN_BASELINE, (value - mean) / np.maximum(spread, MIN_STD), 0.0)
        kept[:, day] = here[:, day] & (np.abs(z[:, day]) < DRIFT_Z)
        total += kept[:, day] * np.stack([np.ones_like(value), value, value * value])
    drift = here & ~kept
    drifts = drift.cumsum(axis=1)
    sustained = np.where(drift, drifts - np.maximum.accumulate(np.where(kept, drifts, 0), axis=1), 0)
    long_run = sustained >= MIN_SUSTAINED
    severity = np.select([long_run & (np.abs(z) >= ALERT_Z), long_run], ["alert", "watch"], "none")
    return np.where(here, z, np.nan), drift, sustained, severity


def daily_values(df: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    return df.groupBy(*key, day).agg(F.avg(value).alias(value))


def _scored(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in series:
        rows = []
        for start in range(0, len(batch), BLOCK):
            block = [np.asarray(v, dtype=float) for v in batch.iloc[start : start + BLOCK]]
            x = np.full((len(block), max(map(len, block))), np.nan)
            for row, v in zip(x, block):
                row[: len(v)] = v
            scored = drift_scores(x)
            rows += [[part[k, : len(v)].tolist() for part in scored] for k, v in enumerate(block)]
        yield pd.DataFrame(rows, columns=["z", "is_drift", "sustained", "severity"])


def monitor(daily: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Score each day against the running baseline of its key; a null value has a null z."""
    key = list(key)
    series = daily.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(day, value))).alias("_days"))
    scored = series.withColumn("_out", F.pandas_udf(_scored, OUT)(F.transform("_days", lambda d: d[value].cast("double"))))
    each = F.arrays_zip("_days", "_out.z", "_out.is_drift", "_out.sustained", "_out.severity")
    rows = scored.select(*key, F.explode(each).alias("_r"))
    return rows.select(
        *key, f"_r._days.{day}", f"_r._days.{value}", F.nanvl("_r.z", F.lit(None).cast("double")).alias("z"),
        "_r.is_drift", "_r.sustained", "_r.severity",
    )
