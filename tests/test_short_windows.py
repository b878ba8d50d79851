"""Windows shorter than their fixed length stay in the results, and empty frames are a parameter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippleframe.operators import calibration as cal
from rippleframe.operators import spectral as spec
from rippleframe.plans import REGISTRY

SF = "/root/testdata/sf0.001"


def _periodicity(x):
    c = np.asarray(x) - np.mean(x)
    e = (c * c).sum()
    if len(c) < 4 or e <= 1e-18:
        return 0.0
    return min(1.0, max(0.0, *[(c[:-k] * c[k:]).sum() / e for k in range(1, max(len(c) // 2 - 1, 1) + 1)], 0.0))


def test_steps_and_periodicity_of_windows_of_any_length(frame):
    rng = np.random.default_rng(3)
    rows = [(n, [float(v) for v in rng.normal(size=n)]) for n in range(1, 34)] + [(100, [2.0] * 9)]
    df = frame(rows, "n int, x array<double>")
    got = {r["n"]: r for r in df.select("n", spec.largest_step("x").alias("j"), spec.periodicity("x").alias("p")).collect()}
    for n, x in rows:
        assert got[n]["j"] == pytest.approx(max([abs(b - a) for a, b in zip(x, x[1:])], default=0.0))
        assert got[n]["p"] == pytest.approx(_periodicity(x), abs=1e-12)


@pytest.mark.parametrize("name", ["breathing_rate", "rescue_breathing", "rescue_heartbeat", "movement_class", "gesture_classify"])
def test_every_window_of_every_node_has_a_row(spark, name):
    size = 12 if name == "gesture_classify" else 32
    nodes = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count().collect()
    out = REGISTRY[name].build(spark, SF).collect()
    assert len(out) == sum(math.ceil(r["count"] / size) for r in nodes)
    assert sum(r["samples"] for r in out) == sum(r["count"] for r in nodes)
    short = [r for r in out if r["samples"] < size]
    assert short
    if "status" in out[0].asDict():
        assert {r["status"] for r in short} == {"unavailable"}


def test_bandpass_returns_every_sample(spark):
    assert REGISTRY["bandpass"].build(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_empty_frames_are_chosen_by_a_column(frame):
    rows = [(0, 1.0, 0.1, True), (0, 3.0, 0.3, True), (0, 90.0, 2.0, False), (0, 80.0, 2.0, None), (1, 5.0, 0.0, False)]
    cells = frame(rows, "sc int, a double, p double, empty boolean")
    one, none = cal.record(cells, "sc", "a", "p", 2, F.col("empty")).orderBy("sc").collect()
    assert (one["amplitude_mean"], one["amplitude_variance"], one["frames"], one["occupied"], one["ready"]) == (2.0, 2.0, 2, 2, True)
    assert one["phase_mean"] == pytest.approx(0.2)
    assert (none["amplitude_mean"], none["phase_dispersion"], none["frames"], none["occupied"], none["ready"]) == (None, None, 0, 1, False)
