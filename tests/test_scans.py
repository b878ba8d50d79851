import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rippleframe.functions import scoring as sc
from rippleframe.operators import longitudinal, scans
from rippleframe.operators import sequence as S
from rippleframe.streaming import steps


def seq_of(frame, values, schema="v double"):
    df = frame([("n", i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"k string, i int, {schema}")
    return S.sequence(df, ["k"], ["i"]).withColumn("pos", F.col("pos") + 0)


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def debounced(hits):
    """Both halves through the stream update, so that its state carries over."""
    state, out = None, []
    for part in (hits[:7], hits[7:]):
        state, rows = steps.debounce(state, pd.DataFrame({"event_id": 0, "hit": part}))
        out += rows["state"].tolist()
    return out


def test_debounce_fixture(frame):
    s = seq_of(frame, [False, True, True, False, False], "hit boolean")
    assert column(scans.debounce(s, ["k"], "hit"), "state") == [False, False, True, True, False]


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_debounce_is_the_step_function(frame, size):
    rng = random.Random(3)
    hits = [rng.random() < 0.5 for _ in range(60)]
    got = column(scans.debounce(seq_of(frame, hits, "hit boolean"), ["k"], "hit", size=size), "state")
    assert got == debounced(hits)


def loop_gate(rows):
    low, out = 0, []
    for s, n, d in rows:
        before = low
        if d >= 0.9 or n >= 0.95 or low >= 200:
            out.append(("recalibrate", before))
            continue
        if s >= 0.85 and n <= 0.35 and d < 0.6:
            low = 0
            out.append(("accept", before))
            continue
        low += 1
        kind = "predict_only" if s >= 0.5 and n < 0.7 else "reject"
        out.append(("recalibrate" if low >= 200 else kind, before))
    return out


@pytest.mark.parametrize("size", [7, 1000])
def test_gate_latches_after_the_stale_budget(frame, size):
    rng = random.Random(5)
    rows = [(rng.random(), rng.random() * 0.8, rng.random() * 0.5) for _ in range(40)] + [(0.1, 0.2, 0.1)] * 205 + [(0.99, 0.0, 0.0)] * 3
    out = scans.gate(seq_of(frame, rows, "s double, n double, d double"), ["k"], "s", "n", "d", size=size)
    got = [(r.action, r.stale_frames) for r in out.orderBy("i").collect()]
    assert got == loop_gate(rows)
    assert got[-1][0] == "recalibrate"


@pytest.mark.parametrize("size", [4, 1000])
def test_known_key_length_and_small_chunks_agree(frame, size):
    """The recorded key length must not hide the carry of a smaller chunk size."""
    rng = random.Random(9)
    hits = [rng.random() < 0.5 for _ in range(40)]
    df = frame([("n", i, h) for i, h in enumerate(hits)], "k string, i int, hit boolean")
    seq = S.sequence(df, ["k"], ["i"])
    assert S.fits(seq, 40) and not S.fits(seq, 39)
    want = debounced(hits)
    assert column(scans.debounce(seq, ["k"], "hit", size=size), "state") == want


def test_ema_residual_fixture(frame):
    out = column(scans.ema_residual(seq_of(frame, [5.0] * 40 + [6.0]), ["k"], "v", 0.1), "residual")
    assert out[0] == 0 and out[-1] == pytest.approx(1.0)


def test_intention_needs_three_frames(frame):
    rows = [(0.05, 0.07, 0.13)] * 4 + [(0.05, 0.70, 0.13)]
    out = scans.intention(seq_of(frame, rows, "s double, e double, l double"), ["k"], "s", "e", "l")
    assert column(out, "label") == ["preparing", "preparing", "likely", "likely", "motion"]


def test_asof_against_brute_force(frame):
    rng = random.Random(7)
    left = [("ab"[rng.randrange(2)], rng.randrange(30), i) for i in range(40)]
    right = [("ab"[rng.randrange(2)], rng.randrange(30), 100 + i) for i in range(12)]
    l, r = frame(left, "k string, t int, i int"), frame(right, "k string, t int, i int").withColumn("rid", F.col("i"))
    got = {x.i: x.match_rid for x in scans.asof(l, r, ["k"], "t", ["i"], ["rid"]).collect()}
    for k, t, i in left:
        before = [(rt, ri) for rk, rt, ri in right if rk == k and rt <= t]
        assert got[i] == (max(before)[1] if before else None)


def test_state_log_fixture(frame):
    rows = [("20", "C", 1), ("20", "F", 2), ("20", "F", 3)]
    out = scans.state_changes(seq_of(frame, rows, "s string, a string, at int"), ["k"], "s", "a", "at").orderBy("i").collect()
    assert [(r.a, r.last_changed) for r in out] == [("C", 1), ("F", 1)]


def test_longitudinal_drift_fixture(frame):
    days = frame([("p", d, v) for d, v in enumerate([0.10] * 7 + [0.5, 0.6, 0.7])], "k string, day int, v double")
    out = longitudinal.monitor(days, ["k"], "day", "v").orderBy("day").collect()
    assert out[-1].severity == "alert" and out[-1].sustained == 3 and out[-1].z > 0
    assert [r.severity for r in out[:9]] == ["none"] * 9


def test_trend_direction(frame):
    days = frame([("p", d, 0.1 * d) for d in range(100)], "k string, day int, v double")
    r = scans.trend(days, ["k"], "day", "v", 90).first()
    assert r.n == 90 and r.direction == "increasing" and r.slope == pytest.approx(0.1) and r.minimum == pytest.approx(1.0)


def test_stateless_gate_and_noise(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert pick(sc.gate_decision(lit(0.9), lit(0.1), lit(0.1), lit(0))) == "accept"
    assert pick(sc.gate_decision(lit(0.9), lit(0.1), lit(0.95), lit(0))) == "recalibrate"
    assert pick(sc.noise_multiplier(lit(0.675))) == pytest.approx(2.0)
    assert pick(sc.identity_gate(lit(float("nan")))) == "accept"
    assert pick(sc.clamp01_or_zero(lit(float("inf")))) == 0.0
    assert pick(sc.identity_risk(lit(0.5), lit(float("nan")))) == 0.0
