import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippleframe.functions import geo
from rippleframe.functions import phase as ph
from rippleframe.functions import vectors as vec
from rippleframe.operators import sequence as S
from rippleframe.operators import spectral as spec
from rippleframe.operators import taps
from rippleframe.operators import windows as win
from rippleframe.operators.quantiles import quantiles


def seq_of(frame, values, extra=""):
    df = frame([("n", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double" + extra)
    return S.sequence(df, ["k"], ["i"]).withColumn("pos", F.col("pos") + 0)


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_hampel_fixture(frame):
    out = win.hampel(seq_of(frame, [1, 1, 1, 10, 1, 1, 1]), ["k"], "v", 2, 3.0).orderBy("i").collect()
    assert [r.filtered for r in out] == [1] * 7
    assert [r.i for r in out if r.is_outlier] == [3] and out[3].sigma == 0


def test_min_max_fixture(spark):
    assert value(spark, vec.min_max_normalize(arr(2, 4, 6))) == [0, 0.5, 1]
    assert value(spark, vec.min_max_normalize(arr(5, 5))) == [0, 0]
    assert value(spark, vec.zscore_normalize(arr(5, 5))) == [0, 0]


def test_window_statistics_fixture(frame):
    cells = [(0, t, c, float(v)) for t, row in enumerate([[1, 2], [2, 4], [4, 8]]) for c, v in enumerate(row)]
    df = frame(cells, "w int, t int, c int, a double").withColumn("p", F.lit(0.0))
    r = win.window_statistics(df, ["w"], ["c"], "t", "a", "p").first()
    x = np.array([[1, 2], [2, 4], [4, 8]], float)
    assert r.motion_energy == pytest.approx(6.25) and r.n_frames == 3
    assert r.mean_amplitude == pytest.approx(x.mean()) and r.amplitude_variance == pytest.approx(x.var())
    assert r.subcarrier_variance == pytest.approx(x.var(axis=0, ddof=1).mean())
    assert r.temporal_delta == pytest.approx(np.abs(np.diff(x, axis=0)).mean())


def test_motion_orders_empty_present_walking(frame):
    rng = np.random.default_rng(3)
    rows = []
    for w, (level, noise) in enumerate([(1.0, 0.002), (1.25, 0.03), (1.3, 0.2)]):
        for t in range(16):
            rows += [(w, t, c, float(level + rng.normal() * noise), float(rng.normal() * noise)) for c in range(8)]
    df = frame(rows, "w int, t int, c int, a double, p double")
    out = win.score_windows(win.window_statistics(df, ["w"], ["c"], "t", "a", "p")).orderBy("w").collect()
    assert out[0].motion_score < out[1].motion_score < out[2].motion_score
    assert [r.state for r in out] == ["empty", "still", "moving"]


@pytest.mark.parametrize("size", [3, 1000])
def test_unwrap_is_numpy(frame, size):
    rng = np.random.default_rng(1)
    phase = np.angle(np.exp(1j * np.cumsum(rng.uniform(-2.5, 2.5, 60))))
    s = seq_of(frame, phase)
    s.sparkSession.conf.set(S.CHUNK_ROWS_CONF, str(size))
    try:
        got = [r.unwrapped for r in win.unwrap(s, ["k"], "v").orderBy("i").collect()]
    finally:
        s.sparkSession.conf.unset(S.CHUNK_ROWS_CONF)
    assert np.allclose(got, np.unwrap(phase))


def test_resample_is_numpy_interp(frame):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(1, 9, 30))
    df = frame([("n", i, int(x), float(i * i)) for i, x in enumerate(t)], "k string, i int, t long, v double")
    out = win.resample(S.sequence(df, ["k"], ["i"]), ["k"], "t", "v", 5).orderBy("grid").collect()
    want = [g for g in range(-(-int(t[0]) // 5), int(t[-1]) // 5 + 1) if t[0] <= g * 5 < t[-1]]
    assert [r.grid for r in out] == want
    assert np.allclose([r.resampled for r in out], np.interp([g * 5 for g in want], t, np.arange(30.0) ** 2))


def test_gate_frames_against_loop(frame):
    rng = np.random.default_rng(4)
    e = np.abs(rng.normal(size=25)) ** 4
    x = (e - e.min()) / np.ptp(e)
    support = np.where(x >= 0.15, x, 0.0)
    for i in np.flatnonzero(x >= 0.3):
        for j in range(max(0, i - 2), min(25, i + 3)):
            support[j] = max(support[j], 1 - abs(i - j) / 3)
    want = 0.7 + 0.6 * np.clip(support, 0, 1)
    got = [r.gain for r in win.gate_frames(seq_of(frame, e), ["k"], "v", strength=0.3).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_split_without_gap_uses_halves(frame):
    df = frame([("k", i, 1.0) for i in range(5)] + [("g", i, v) for i, v in enumerate([1.0, 1.1, 9.0, 9.2])], "k string, i int, v double")
    out = win.largest_gap_split(df, ["k"], "i", "v").orderBy("k", "i").collect()
    assert [r.i for r in out if r.k == "k" and r.sensitive] == [0, 1]
    assert [r.i for r in out if r.k == "g" and r.sensitive] == [2, 3]
    assert out[3].weight == pytest.approx(2.0) and out[0].weight == 0.5


def test_sliding_windows_cover_by_position(frame):
    out = win.sliding(seq_of(frame, range(20)), 8, 3).groupBy("win").agg(F.count("*").alias("n"), F.min("pos").alias("lo"))
    got = {r.win: (r.lo, r.n) for r in out.collect()}
    assert got == {w: (3 * w, min(20, 3 * w + 8) - 3 * w) for w in range(7)}


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_quantiles_are_numpy(frame, n):
    rng = random.Random(n)
    v = [float(rng.randrange(9)) for _ in range(n)]
    df = frame([("k", x, i) for i, x in enumerate(v)], "k string, v double, i int")
    r = quantiles(df, ["k"], "v", ["i"], {"a": 0.05, "b": 0.5, "c": 0.9}).first()
    assert np.allclose([r.a, r.b, r.c], np.quantile(v, [0.05, 0.5, 0.9]))


def rate_of(frame, hz, rate, seconds, low, high, needed):
    n = int(rate * seconds)
    x = [math.sin(2 * math.pi * hz * i / rate) for i in range(n)]
    size = 1 << (n - 1).bit_length()
    df = frame([(x,)], "x array<double>").withColumn("a", spec.spectrum_amplitude("x"))
    df = df.withColumn("peak", spec.band_peak("a", rate, size, low, high, power=True))
    est = spec.vital_estimate(F.col("peak"), rate, size, low, high, seconds, needed)
    return df.select(*[c.alias(k) for k, c in est.items()]).first()


def test_breathing_recovers_18_bpm(frame):
    r = rate_of(frame, 0.3, 20.0, 30, 0.1, 0.5, 10.0)
    assert abs(r.bpm - 18) < 1.5 and r.status == "valid" and r.confidence >= 0.72


def test_heart_recovers_72_bpm(frame):
    r = rate_of(frame, 1.2, 50.0, 15, 0.8, 2.0, 5.0)
    assert abs(r.bpm - 72) < 2 and r.status == "valid"


def test_short_window_is_unavailable(frame):
    r = rate_of(frame, 0.3, 20.0, 3, 0.1, 0.5, 10.0)
    assert r.bpm is None and r.status == "unavailable"


def test_filters_are_numpy(frame):
    rng = np.random.default_rng(5)
    x = rng.normal(size=40)
    df = frame([(x.tolist(), 0.3)], "x array<double>, f double")
    r = df.select(spec.bandpass("x", 4.0, 0.2, 0.9).alias("b"), spec.high_pass("x", 4.0, 0.8).alias("h"), spec.notch("x", "f", 4.0).alias("n")).first()
    z, f = np.fft.rfft(x - x.mean()), np.fft.rfftfreq(40, 0.25)
    z[(f < 0.2) | (f > 0.9)] = 0
    assert np.allclose(r.b, np.fft.irfft(z, 40))
    a = (1 / (2 * math.pi * 0.8)) / (1 / (2 * math.pi * 0.8) + 0.25)
    y = [x[0]]
    for i in range(1, 40):
        y.append(a * (y[-1] + x[i] - x[i - 1]))
    assert np.allclose(r.h, y)
    c, q = math.cos(2 * math.pi * 0.3 / 4), 1 - math.pi * 0.05 / 4
    out = []
    for i in range(40):
        back = lambda s, k: s[i - k] if i >= k else 0.0
        out.append(x[i] - 2 * c * back(x, 1) + back(x, 2) + 2 * q * c * back(out, 1) - q * q * back(out, 2))
    assert np.allclose(r.n, out)


def test_periodicity_and_taps(spark):
    x = [math.sin(i) for i in range(30)]
    c = np.array(x) - np.mean(x)
    want = max((c[:-k] @ c[k:]) / (c @ c) for k in range(1, 15))
    assert value(spark, spec.periodicity(arr(*x))) == pytest.approx(want)
    m = arr(0.1, 5.0, 4.9, 0.2, 3.0, 2.0)
    assert value(spark, taps.sparse_taps(m, F.lit(1.0), 3)) == [1, 2, 4]
    assert value(spark, taps.sparse_taps(m, F.lit(1.0), 3, separation=1)) == [1, 4]


def test_vector_functions(spark):
    v = np.array([0.5, -1.0, 2.0, 2.0])
    a = arr(*v)
    assert np.allclose(value(spark, vec.softmax(a)), np.exp(v) / np.exp(v).sum())
    assert value(spark, vec.argmax(a)) == 2 and value(spark, vec.top_indices(a, 3)) == [2, 3, 0]
    assert np.allclose(value(spark, vec.resample(a, 7)), np.interp(np.linspace(0, 3, 7), range(4), v))
    assert value(spark, vec.fit_length(a, 6)) == [0.5, -1, 2, 2, 2, 2] and value(spark, vec.fit_length(a, 2)) == [2, 2]
    assert value(spark, vec.cosine(a, arr(0, 0, 0, 0))) == 0
    assert value(spark, vec.normalize_weights(arr(0, 0))) == [0.5, 0.5]
    angles = [0.0, 0.1, 3.0]
    corr = [[math.exp(-(min(abs(x - y), 2 * math.pi - abs(x - y)) ** 2) / (2 * 0.25)) for y in angles] for x in angles]
    assert value(spark, vec.effective_viewpoints(arr(*angles), 0.5)) == pytest.approx(9 / sum(c * c for r in corr for c in r))


def test_coherence_of_rotated_frames(spark):
    z = F.array(*[F.struct(F.lit(float(i)).alias("re"), F.lit(1.0).alias("im")) for i in range(4)])
    c = value(spark, ph.coherence(z, ph.rotate(z, F.lit(0.7))))
    assert c.correlation == pytest.approx(1) and c.magnitude == pytest.approx(1) and c.score == pytest.approx(1)
    assert value(spark, ph.lo_phase_offset(z, ph.rotate(z, F.lit(-0.7)))) == pytest.approx(0.7)


def test_geometry(spark):
    box = lambda x, y, w, h: F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xywh", (x, y, w, h))])
    assert value(spark, geo.iou(box(0, 0, 2, 2), box(1, 1, 2, 2))) == pytest.approx(1 / 7)
    p = lambda x, y, z: F.struct(*[(F.lit(None) if v is None else F.lit(float(v))).cast("double").alias(n) for n, v in zip("xyz", (x, y, z))])
    assert value(spark, geo.distance3(p(0, 0, 0), p(1, 2, 2))) == pytest.approx(3)
    assert value(spark, geo.distance3(p(0, 0, None), p(3, 4, 9))) == pytest.approx(5)
    assert value(spark, geo.segment_distance(p(5, 3, 0), p(0, 0, 0), p(4, 0, 0))) == pytest.approx(math.hypot(1, 3))
    assert value(spark, geo.rssi_to_distance(F.lit(-30.0))) == pytest.approx(1)
    assert value(spark, geo.toa_to_distance(F.lit(10 / geo.SPEED_OF_LIGHT * 1e9))) == pytest.approx(5)
    assert geo.polygon_area([(0, 0), (4, 0), (4, 3), (0, 3)]) == 12
    assert value(spark, geo.depth_from_attenuation(F.lit(2.0), F.lit(0.0))).depth == 0
    assert value(spark, geo.depth_from_attenuation(F.lit(99.0), F.lit(0.0))) is None
    assert value(spark, geo.combine_sigma(F.lit(1.0), F.lit(1.0))) == pytest.approx(math.sqrt(0.5))
    fp = lambda b, a, h, x: F.struct(F.lit(b).alias("breathing"), F.lit(a).alias("amplitude"), F.lit(h).cast("double").alias("heart"), F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert value(spark, geo.fingerprint_distance(fp(15.0, 0.5, None, 0.0), fp(18.0, 0.5, 70.0, 0.0))) == pytest.approx(0.04 / 0.8)
