"""Rates, filters and impulse responses of bounded windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import vectors as vec
from rippleframe.operators import sequence as seqs
from rippleframe.operators import spectral as spec
from rippleframe.operators import taps
from rippleframe.operators import windows as win
from rippleframe.plans.registry import Tables, query, r6
from rippleframe.plans.windows import EV, node_sequence

N, RATE = 32, 2.0

WINDOWED = f"""{EV}, a AS (SELECT user_id, pos // 32 AS win, pos % 32 AS i, event_id, amp, count(*) OVER v AS n, avg(amp) OVER v AS m
  FROM ev WINDOW v AS (PARTITION BY user_id, pos // 32)),
sizes AS (SELECT user_id, win, count(*) AS samples FROM a GROUP BY ALL),
t AS (SELECT user_id, win, i, event_id, amp - m AS c, (amp - m) * (0.5 - 0.5 * cos(2 * pi() * i / 31)) AS h FROM a WHERE n = 32)"""


def _dft(source, column):
    return f"""SELECT user_id, win, k, sqrt(sum({column} * cos(2 * pi() * k * i / 32))^2 + sum({column} * sin(2 * pi() * k * i / 32))^2) AS x
  FROM {source}, (SELECT unnest(range(1, 17)) AS k) GROUP BY ALL"""


def _peak(lo, hi):
    return f"""b AS (SELECT user_id, win, max(x * x) FILTER (k BETWEEN {lo} AND {hi}) AS top, sum(x * x) FILTER (k BETWEEN {lo} AND {hi}) AS band,
  sum(x * x) AS tot, arg_max(k, x) FILTER (k BETWEEN {lo} AND {hi}) AS k0 FROM f GROUP BY ALL),
g AS (SELECT b.*, quantile_cont(f.x * f.x, 0.5) FILTER (k BETWEEN {lo} AND {hi} AND x * x < top) AS back,
  coalesce(max(x) FILTER (k = k0 - 1), 0) AS xl, max(x) FILTER (k = k0) AS xm, max(x) FILTER (k = k0 + 1) AS xr
  FROM b JOIN f USING (user_id, win) GROUP BY ALL)"""


CONF = """greatest(0, least(1, (0.65 * greatest(0, least(1, (log2(greatest(top / greatest(back, 1e-20), 1)) - 0.25) / 3))
  + 0.35 * least(1, band / tot / 0.35)) * least(1, band / tot / 0.25)))"""
STATUS = """CASE WHEN conf >= 0.72 THEN 'valid' WHEN conf >= 0.45 THEN 'degraded' WHEN conf >= 0.18 THEN 'unreliable' ELSE 'unavailable' END"""


def _windows(spark, sf_dir, column="amp"):
    """Windows of 32 samples as arrays; the last of a node may be shorter."""
    seq = win.tumbling(node_sequence(spark, sf_dir, column), N)
    return win.window_arrays(seq, ["user_id", "win"], column)


def _length():
    return F.size("samples").cast("bigint").alias("samples")


def _detected(found):
    status = F.when(F.col("samples") < N, "unavailable").when(found, "detected").otherwise("none")
    return status.alias("status")


def _if_full(values):
    """Null for windows that are too short for the bins of a whole one."""
    return F.when(F.size("samples") == N, values)


@query(
    f"""WITH {WINDOWED}, f AS ({_dft('t', 'h')}), {_peak(2, 8)},
c AS (SELECT *, {CONF} AS conf, 0.5 * (xl * xl - xr * xr) / (xl * xl - 2 * xm * xm + xr * xr) AS shift FROM g)
SELECT user_id, win, CASE WHEN samples = 32 THEN round(60 * greatest(0.1, least(0.5, (k0 + greatest(-1, least(1, shift))) * 0.0625)), 5) END AS bpm,
  coalesce(round(conf, 5), 0) AS confidence, {STATUS} AS status, samples FROM sizes LEFT JOIN c USING (user_id, win)"""
)
def breathing_rate(spark, sf_dir):
    """Breathing band .1 to .5 Hz over 16 s windows at 2 Hz; unavailable for a shorter last window."""
    rows = _windows(spark, sf_dir).withColumn("a", _if_full(spec.spectrum_amplitude("samples")))
    rows = rows.withColumn("peak", spec.band_peak("a", RATE, N, 0.1, 0.5, power=True))
    est = spec.vital_estimate(F.col("peak"), RATE, N, 0.1, 0.5, N / RATE, 10.0)
    return rows.select(
        "user_id", "win", r6(est["bpm"], 5).alias("bpm"), r6(est["confidence"], 5).alias("confidence"),
        est["status"].alias("status"), _length(),
    )


@query(
    f"""WITH {WINDOWED}, f AS ({_dft('t', 'h')}), {_peak(2, 10)},
s AS (SELECT *, greatest((k0 + 0.5 * (xl - xr) / (xl - 2 * xm + xr)) * 0.0625, 0) AS hz FROM g),
r AS (SELECT s.user_id, s.win, any_value(hz) AS hz, sqrt(any_value(top)) / 7.75 AS amp, greatest(0, least(1, 3 * (any_value(top)
  + 0.5 * (coalesce(sum(x * x) FILTER (k = round(hz * 2 / 0.0625) AND hz * 2 <= 1), 0)
    + coalesce(sum(x * x) FILTER (k = round(hz * 3 / 0.0625) AND hz * 3 <= 1), 0))) / any_value(tot))) AS reg
  FROM s JOIN f USING (user_id, win) GROUP BY s.user_id, s.win),
d AS (SELECT user_id, win, round(hz * 60, 5) AS bpm, round(amp, 5) AS amplitude, round(reg, 5) AS regularity,
  CASE WHEN hz * 60 < 6 AND reg < 0.3 THEN 'agonal' WHEN hz * 60 < 10 THEN 'shallow' WHEN hz * 60 > 30 THEN 'labored'
  WHEN reg < 0.4 THEN 'irregular' ELSE 'normal' END AS pattern FROM r
WHERE amp >= 0.1 AND 0.4 * least(amp, 1) + 0.6 * reg >= 0.3)
SELECT user_id, win, samples, bpm, amplitude, regularity, pattern,
  CASE WHEN samples < 32 THEN 'unavailable' WHEN bpm IS NULL THEN 'none' ELSE 'detected' END AS status FROM sizes LEFT JOIN d USING (user_id, win)"""
)
def rescue_breathing(spark, sf_dir):
    """Breathing pattern between 4 and 40 BPM; weak and unsure windows detect none, short ones are unavailable."""
    rows = _windows(spark, sf_dir).withColumn("a", _if_full(spec.spectrum_amplitude("samples")))
    rows = rows.withColumn("peak", spec.band_peak("a", RATE, N, 4 / 60, 40 / 60, power=False))
    est = spec.rescue_peak(F.col("peak"), "a", RATE, N, gain=7.75)
    rows = rows.select("user_id", "win", _length(), *[c.alias(n) for n, c in est.items()])
    found = (F.col("amplitude") >= 0.1) & (F.col("confidence") >= 0.3)
    return rows.select(
        "user_id", "win", "samples", *[F.when(found, r6(c, 5)).alias(c) for c in ("bpm", "amplitude", "regularity")],
        F.when(found, spec.breathing_type(F.col("bpm"), F.col("regularity"))).alias("pattern"), _detected(found),
    )


ALPHA = "((1 / (2 * pi() * 0.2)) / (1 / (2 * pi() * 0.2) + 0.5))"


@query(
    f"""WITH {WINDOWED}, d AS (SELECT user_id, win, i, amp - coalesce(lag(amp) OVER (PARTITION BY user_id, win ORDER BY i), 0) AS d,
  pow({ALPHA}, CASE WHEN i = 0 THEN 0 ELSE 1 END) AS g FROM a WHERE n = 32),
y AS (SELECT o.user_id, o.win, o.i, sum(d.d * d.g * pow({ALPHA}, o.i - d.i)) AS y FROM d o JOIN d ON o.user_id = d.user_id AND o.win = d.win AND d.i <= o.i GROUP BY ALL),
z AS (SELECT *, (y - avg(y) OVER (PARTITION BY user_id, win)) * (0.42 - 0.5 * cos(2 * pi() * i / 31) + 0.08 * cos(4 * pi() * i / 31)) AS h FROM y),
f AS ({_dft('z', 'h')}), {_peak(8, 16)},
r AS (SELECT user_id, win, round(60 * (k0 + CASE WHEN xr IS NULL THEN 0 ELSE 0.5 * (xl - xr) / (xl - 2 * xm + xr) END) * 0.0625, 5) AS bpm,
  round(xm / 6.51, 5) AS amplitude FROM g WHERE xm / 6.51 >= 0.05 AND (xr IS NULL OR (xm > xl AND xm > xr)))
SELECT user_id, win, samples, bpm, amplitude, CASE WHEN samples < 32 THEN 'unavailable' WHEN bpm IS NULL THEN 'none' ELSE 'detected' END AS status
FROM sizes LEFT JOIN r USING (user_id, win)"""
)
def rescue_heartbeat(spark, sf_dir):
    """High-passed, Blackman-tapered peak from 30 BPM up; needs a local maximum. Short windows are unavailable."""
    rows = _windows(spark, sf_dir).withColumn("y", spec.high_pass("samples", RATE, 0.2))
    rows = rows.withColumn("a", _if_full(spec.spectrum_amplitude("y", "blackman")))
    rows = rows.withColumn("peak", spec.band_peak("a", RATE, N, 30 / 60, 200 / 60, power=False))
    est = spec.rescue_peak(F.col("peak"), "a", RATE, N, gain=6.51)
    top = F.coalesce(F.col("peak.local_max"), F.lit(True))
    rows = rows.select("user_id", "win", _length(), est["bpm"].alias("bpm"), est["amplitude"].alias("amplitude"), top.alias("top"))
    found = F.col("top") & (F.col("amplitude") >= 0.05)
    return rows.select("user_id", "win", "samples", *[F.when(found, r6(c, 5)).alias(c) for c in ("bpm", "amplitude")], _detected(found))


@query(
    f"""WITH {WINDOWED}, w AS (SELECT user_id, win, i, n, amp, amp - m AS c FROM a),
z AS (SELECT user_id, win, k, sum(c * cos(2 * pi() * k * i / n)) AS re, -sum(c * sin(2 * pi() * k * i / n)) AS im
  FROM w, (SELECT unnest(range(1, 17)) AS k) WHERE k * (1 / (n * 0.5::DOUBLE)) BETWEEN 0.1::DOUBLE AND 0.5::DOUBLE GROUP BY ALL)
SELECT w.user_id, w.win, w.i, CASE WHEN any_value(n) < 3 THEN round(any_value(amp), 6)
  ELSE round(coalesce(sum(re * cos(2 * pi() * k * i / n) - im * sin(2 * pi() * k * i / n)), 0) / (any_value(n) * 0.5::DOUBLE), 6) END AS filtered
FROM w LEFT JOIN z USING (user_id, win) GROUP BY w.user_id, w.win, w.i"""
)
def bandpass(spark, sf_dir):
    """Brick-wall .1 to .5 Hz per window, a shorter last one included, back to one row per sample."""
    rows = _windows(spark, sf_dir).withColumn("y", spec.bandpass("samples", RATE, 0.1, 0.5))
    rows = rows.select("user_id", "win", F.posexplode("y").alias("i", "y"))
    return rows.select("user_id", "win", "i", r6("y").alias("filtered"))


@query(
    f"""WITH {WINDOWED}, w AS (SELECT user_id, win, i, n, amp - m AS c FROM a),
q AS (SELECT user_id, win, any_value(n) AS samples, var_pop(c) AS v, sum(c * c) AS e, coalesce(max(j), 0) AS j FROM (SELECT *, abs(c - lag(c) OVER (PARTITION BY user_id, win ORDER BY i)) AS j FROM w) GROUP BY ALL),
l AS (SELECT x.user_id, x.win, y.i - x.i AS lag, sum(x.c * y.c) AS s FROM w x JOIN w y ON x.user_id = y.user_id AND x.win = y.win AND y.i > x.i AND y.i - x.i < x.n // 2 AND x.n >= 4 GROUP BY ALL),
p AS (SELECT q.user_id, q.win, any_value(samples) AS samples, any_value(v) AS v, any_value(j) AS j, greatest(0, coalesce(max(CASE WHEN e > 1e-18 THEN s / e END), 0)) AS per FROM q LEFT JOIN l USING (user_id, win) GROUP BY ALL)
SELECT user_id, win, samples, round(v, 6) AS variance, round(j, 6) AS max_step, round(per, 6) AS periodicity,
  round(0.6 * least(v, 1) + 0.4 * least(j / 0.5, 1), 6) AS intensity,
  CASE WHEN v < 0.05 AND j < 0.1 THEN 'none' WHEN j > 0.5 AND v > 0.1 THEN 'gross' WHEN per > 0.3 AND v < 0.2 THEN 'periodic'
  WHEN per > 0.3 THEN 'tremor' WHEN v > 0.05 THEN 'fine' ELSE 'none' END AS movement FROM p"""
)
def movement_class(spark, sf_dir):
    """Variance, largest step and autocorrelation periodicity per window, a shorter last one included, on the JVM."""
    rows = _windows(spark, sf_dir).select(
        "user_id", "win", _length().alias("n"), vec.var_pop("samples").alias("v"), spec.largest_step("samples").alias("j"),
        spec.periodicity("samples").alias("p"),
    )
    return rows.select(
        "user_id", "win", F.col("n").alias("samples"), r6("v").alias("variance"), r6("j").alias("max_step"), r6("p").alias("periodicity"),
        r6(spec.movement_intensity(F.col("v"), F.col("j"))).alias("intensity"),
        spec.movement(F.col("v"), F.col("j"), F.col("p")).alias("movement"),
    )


def _residual():
    """Frame residual weighted by the phase agreement of neighbouring subcarriers."""
    return vec.let(
        F.transform("embedding", lambda x: x.cast("double") * 8),
        lambda p: vec.let(vec.smooth_phase_weights(p), lambda w: vec.dot("embedding", w) / vec.total(w)),
    )


@query(
    """WITH u AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
p AS (SELECT *, x * 8 AS phi, lead(x * 8) OVER w - x * 8 AS fwd, x * 8 - lag(x * 8) OVER w AS bwd FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT *, exp(-abs(atan2(sin(coalesce(fwd, bwd)), cos(coalesce(fwd, bwd))))) AS w FROM p)
SELECT vec_id, label, round(sum(x * w) / sum(w), 7) AS residual FROM g GROUP BY vec_id, label"""
)
def heart_residual(spark, sf_dir):
    """Residual vector to scalar, weighted by the phase agreement of neighbours."""
    em = Tables(spark, sf_dir).embeddings
    return em.select("vec_id", "label", r6(_residual(), 7).alias("residual"))


@query(
    """WITH u AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
p AS (SELECT *, x * 8 AS phi, lead(x * 8) OVER w - x * 8 AS fwd, x * 8 - lag(x * 8) OVER w AS bwd FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
wt AS (SELECT *, exp(-abs(atan2(sin(coalesce(fwd, bwd)), cos(coalesce(fwd, bwd))))) AS w FROM p),
r AS (SELECT label, vec_id, sum(x * w) / sum(w) AS r FROM wt GROUP BY ALL),
o AS (SELECT label, r, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM r),
a AS (SELECT label AS user_id, pos // 32 AS win, pos % 32 AS i, r, count(*) OVER v AS n, avg(r) OVER v AS m FROM o WINDOW v AS (PARTITION BY label, pos // 32)),
sizes AS (SELECT user_id, win, count(*) AS samples FROM a GROUP BY ALL),
t AS (SELECT user_id, win, i, (r - m) * (0.5 - 0.5 * cos(2 * pi() * i / 31)) AS h FROM a WHERE n = 32), f AS ("""
    + _dft("t", "h")
    + f"""), {_peak(4, 8)}, c AS (SELECT *, {CONF} AS conf, 0.5 * (xl * xl - xr * xr) / (xl * xl - 2 * xm * xm + xr * xr) AS shift FROM g)
SELECT user_id AS label, win, CASE WHEN samples = 32 THEN round(60 * greatest(0.8, least(2.0, (k0 + greatest(-1, least(1, shift))) * 0.25)), 5) END AS bpm,
  coalesce(round(conf, 5), 0) AS confidence, {STATUS} AS status, samples FROM sizes LEFT JOIN c USING (user_id, win)"""
)
def heart_rate(spark, sf_dir):
    """Heart band .8 to 2 Hz over four-second windows of room frames at 8 Hz; unavailable for a shorter last window."""
    em = Tables(spark, sf_dir).embeddings
    rows = em.select("label", "vec_id", _residual().alias("r"))
    seq = win.tumbling(seqs.sequence(rows, ["label"], ["vec_id"]), N)
    rows = win.window_arrays(seq, ["label", "win"], "r")
    rows = rows.withColumn("a", _if_full(spec.spectrum_amplitude("samples")))
    rows = rows.withColumn("peak", spec.band_peak("a", 8.0, N, 0.8, 2.0, power=True))
    est = spec.vital_estimate(F.col("peak"), 8.0, N, 0.8, 2.0, 4.0, 3.0)
    return rows.select(
        "label", "win", r6(est["bpm"], 5).alias("bpm"), r6(est["confidence"], 5).alias("confidence"),
        est["status"].alias("status"), _length(),
    )


@query(
    """WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS x FROM embeddings),
z AS (SELECT vec_id, j % 32 AS j, max(x) FILTER (j < 32) AS re, max(x) FILTER (j >= 32) AS im FROM u GROUP BY ALL),
g AS (SELECT vec_id, CASE WHEN j < 16 THEN j - 16 ELSE j - 15 END AS k, re * (0.5 - 0.5 * cos(2 * pi() * j / 31)) AS re, im * (0.5 - 0.5 * cos(2 * pi() * j / 31)) AS im FROM z),
c AS (SELECT vec_id, b, sqrt(sum(re * cos(2 * pi() * k * b / 64) - im * sin(2 * pi() * k * b / 64))^2
  + sum(re * sin(2 * pi() * k * b / 64) + im * cos(2 * pi() * k * b / 64))^2) / 15.5 AS m FROM g, (SELECT unnest(range(0, 64)) AS b) GROUP BY ALL),
s AS (SELECT vec_id, max(m) AS top, sum(m) AS tot, arg_max(b, m) AS dominant, sum(m * m) AS pw, sum(b * m * m) / sum(m * m) AS ctr, quantile_cont(m, 0.5) AS med FROM c GROUP BY ALL),
d AS (SELECT s.vec_id, any_value(dominant) AS dominant, any_value(top / tot) AS ratio, count(*) FILTER (m >= top * 0.01) AS active,
  sqrt(sum((b - ctr)^2 * m * m) / any_value(pw)) AS spread, any_value(med) + 1.4826 * quantile_cont(abs(m - med), 0.5) AS floor,
  list(b ORDER BY m DESC)[1:4] AS strongest FROM s JOIN c USING (vec_id) GROUP BY ALL)
SELECT vec_id, dominant AS dominant_bin, round(ratio, 6) AS dominant_ratio, active AS active_taps, round(spread, 5) AS delay_spread,
  round(floor, 6) AS noise_floor, array_to_string(strongest, ',') AS strongest FROM d"""
)
def cir_estimate(spark, sf_dir):
    """Impulse response of 32 complex subcarriers on a 64-bin delay grid."""
    em = Tables(spark, sf_dir).embeddings
    rows = em.select(
        "vec_id", spec.impulse_response(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), 64).alias("m")
    )
    ranked = taps.sparse_taps("m", F.lit(0.0), 4)
    return rows.select(
        "vec_id",
        (F.array_position("m", F.array_max("m")) - 1).alias("dominant_bin"),
        r6(F.array_max("m") / vec.total("m")).alias("dominant_ratio"),
        taps.active_taps("m").cast("bigint").alias("active_taps"),
        r6(taps.delay_spread("m"), 5).alias("delay_spread"),
        r6(taps.noise_floor("m")).alias("noise_floor"),
        F.array_join(F.transform(ranked, lambda b: b.cast("string")), ",").alias("strongest"),
    )
