"""Window statistics, presence and motion, filters, and reshaping queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rippleframe.functions import scoring as sc
from rippleframe.operators import sequence as seqs
from rippleframe.operators import windows as win
from rippleframe.operators.quantiles import quantiles
from rippleframe.plans.registry import Tables, epoch_us, query, r6

NODE = ["user_id"]

# The samples of a node: amplitude around 1, phase from the fraction of a
# multiple of the value.
EV = """ev AS (SELECT user_id, event_id, ts, event_type, value, epoch_us(ts) AS us,
  0.8 + value / 203 AS amp, (value * 0.6180339887 - floor(value * 0.6180339887)) * 2 * pi() - pi() AS phase,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""
STEP = """CASE WHEN lag(phase) OVER w IS NULL THEN phase
  WHEN abs(phase - lag(phase) OVER w) < pi() THEN phase - lag(phase) OVER w
  ELSE ((phase - lag(phase) OVER w + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi() END"""


def samples(spark, sf_dir, *columns):
    """Node samples with the derived columns the queries use, before sequencing."""
    ev = Tables(spark, sf_dir).events
    turns = F.col("value") * 0.6180339887
    derived = {
        "amp": F.lit(0.8) + F.col("value") / 203,
        "phase": (turns - F.floor(turns)) * 2 * math.pi - math.pi,
        "us": epoch_us("ts"),
    }
    picked = [derived[c].alias(c) if c in derived else F.col(c) for c in columns]
    return ev.select("user_id", "ts", "event_id", *picked)


def node_sequence(spark, sf_dir, *columns):
    return seqs.sequence(samples(spark, sf_dir, *columns), NODE, ["ts", "event_id"]).drop("ts")


@query(
    f"""WITH {EV}, d AS (SELECT *, amp - lag(amp) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM ev)
SELECT user_id, count(*) AS n, round(avg(amp), 6) AS mean_amplitude, round(var_pop(amp), 6) AS var_amplitude,
  round(avg(abs(d)), 6) AS mean_abs_step, round(avg(d * d), 6) AS motion_energy
FROM d GROUP BY user_id"""
)
def window_features(spark, sf_dir):
    """Mean, variance, mean step size and motion energy of every node."""
    rows = win.steps(node_sequence(spark, sf_dir, "amp"), NODE, "amp")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("amp")).alias("mean_amplitude"),
        r6(F.var_pop("amp")).alias("var_amplitude"),
        r6(F.avg(F.abs("step"))).alias("mean_abs_step"),
        r6(F.avg(F.col("step") * F.col("step"))).alias("motion_energy"),
    )


def _window_stats(spark, sf_dir):
    seq = win.tumbling(node_sequence(spark, sf_dir, "amp", "phase"), 16)
    return win.window_statistics(seq, ["user_id", "win"], [], "pos", "amp", "phase")


STATS = f"""{EV}, st AS (SELECT *, pos // 16 AS win FROM ev),
sd AS (SELECT *, amp - lag(amp) OVER w AS d, {STEP} AS turn FROM st
  WINDOW w AS (PARTITION BY user_id, win ORDER BY pos)),
su AS (SELECT *, sum(turn) OVER (PARTITION BY user_id, win ORDER BY pos) AS unwrapped FROM sd),
stats AS (SELECT user_id, win, count(*) AS n_frames, avg(amp) AS mean_amplitude,
  var_pop(amp) AS amplitude_variance, coalesce(avg(abs(d)), 0) AS temporal_delta,
  coalesce(avg(d * d), 0) AS motion_energy, var_pop(unwrapped) AS phase_variance,
  coalesce(var_samp(amp), 0) AS subcarrier_variance FROM su GROUP BY user_id, win)"""
CLAMP = "greatest(0, least(1, {}))"
ABSOLUTE = f"""{STATS}, parts AS (SELECT *, {CLAMP.format('temporal_delta / 0.04')} AS cd,
  {CLAMP.format('amplitude_variance / 0.03')} AS ca, {CLAMP.format('phase_variance / 0.004')} AS cp,
  {CLAMP.format('subcarrier_variance / 0.015')} AS cs FROM stats),
scored AS (SELECT *, {CLAMP.format('(0.35 * cd + 0.30 * ca + 0.20 * cp + 0.15 * cs) / 1.0')} AS motion FROM parts)"""


@query(
    f"""WITH {STATS} SELECT user_id, win, n_frames, round(mean_amplitude, 6) AS mean_amplitude,
  round(amplitude_variance, 6) AS amplitude_variance, round(temporal_delta, 6) AS temporal_delta,
  round(motion_energy, 6) AS motion_energy, round(phase_variance, 6) AS phase_variance,
  round(subcarrier_variance, 6) AS subcarrier_variance FROM stats"""
)
def measure_baseline(spark, sf_dir):
    """Six baseline statistics per window of 16 frames."""
    s = _window_stats(spark, sf_dir)
    names = [c for c in s.columns if c not in ("user_id", "win", "n_frames")]
    return s.select("user_id", "win", "n_frames", *[r6(c).alias(c) for c in names])


@query(
    f"""WITH {ABSOLUTE} SELECT user_id, win, round(cd, 6) AS delta_component,
  round(ca, 6) AS amplitude_component, round(cp, 6) AS phase_component,
  round(cs, 6) AS subcarrier_component, round(motion, 6) AS motion_score FROM scored"""
)
def motion_score(spark, sf_dir):
    out = win.score_windows(_window_stats(spark, sf_dir))
    names = ["delta_component", "amplitude_component", "phase_component", "subcarrier_component", "motion_score"]
    return out.select("user_id", "win", *[r6(c).alias(c) for c in names])


@query(
    f"""WITH {ABSOLUTE}, p AS (SELECT *,
  {CLAMP.format("0.5 * " + CLAMP.format("(mean_amplitude - 1.05) / 0.25")
                + " + 0.25 * " + CLAMP.format("amplitude_variance / 0.03") + " + 0.15 * motion + 0.10 * cs")} AS score
  FROM scored)
SELECT user_id, win, round(score, 6) AS presence_score, CASE WHEN score < 0.35 THEN 'empty'
  WHEN motion >= 0.45 THEN 'moving' ELSE 'still' END AS state FROM p"""
)
def presence_state(spark, sf_dir):
    out = win.score_windows(_window_stats(spark, sf_dir))
    return out.select("user_id", "win", r6("presence_score").alias("presence_score"), "state")


def _rel(v, r, rel, ab):
    return CLAMP.format(
        f"CASE WHEN abs({r}) > 1e-12 THEN ({v} - {r}) / (abs({r}) * {rel}) ELSE {v} / {ab} END"
    )


@query(
    f"""WITH {STATS}, j AS (SELECT s.*, b.temporal_delta AS bd, b.amplitude_variance AS ba,
  b.phase_variance AS bp, b.subcarrier_variance AS bs, b.mean_amplitude AS bm
  FROM stats s JOIN stats b ON s.user_id = b.user_id AND b.win = 0 WHERE s.win > 0),
parts AS (SELECT *, {_rel('temporal_delta', 'bd', '1.0', '0.03')} AS cd,
  {_rel('amplitude_variance', 'ba', '1.0', '0.02')} AS ca, {_rel('phase_variance', 'bp', '1.0', '0.003')} AS cp,
  {_rel('subcarrier_variance', 'bs', '1.0', '0.01')} AS cs FROM j),
m AS (SELECT *, {CLAMP.format('0.35 * cd + 0.30 * ca + 0.20 * cp + 0.15 * cs')} AS motion FROM parts),
p AS (SELECT *, {CLAMP.format('0.5 * ' + _rel('mean_amplitude', 'bm', '0.15', '0.20') + ' + 0.25 * '
      + _rel('amplitude_variance', 'ba', '0.8', '0.02') + ' + 0.15 * motion + 0.10 * cs')} AS score FROM m)
SELECT user_id, win, round(motion, 6) AS motion_score, round(score, 6) AS presence_score,
  CASE WHEN score < 0.35 THEN 'empty' WHEN motion >= 0.45 THEN 'moving' ELSE 'still' END AS state FROM p"""
)
def presence_vs_baseline(spark, sf_dir):
    """Scores relative to the first window of the node."""
    stats = _window_stats(spark, sf_dir)
    first = stats.filter("win = 0").drop("win", "n_frames")
    first = first.select("user_id", *[F.col(c).alias(f"base_{c}") for c in first.columns[1:]])
    rows = seqs.attach(stats.filter("win > 0"), first, NODE, "inner")
    out = win.score_windows(rows, "base_")
    return out.select(
        "user_id", "win", r6("motion_score").alias("motion_score"),
        r6("presence_score").alias("presence_score"), "state",
    )


@query(
    f"""WITH {EV} SELECT event_id, user_id, round(avg(amp) OVER w, 6) AS rolling_mean,
  round(var_pop(amp) OVER w, 6) AS rolling_var FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)"""
)
def rolling_mean_var(spark, sf_dir):
    out = win.rolling(node_sequence(spark, sf_dir, "amp"), NODE, "amp", 16)
    return out.select(
        "event_id", "user_id", r6("rolling_mean").alias("rolling_mean"), r6("rolling_var").alias("rolling_var")
    )


@query(
    f"""WITH {EV}, d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS s FROM ev),
l AS (SELECT user_id, count(*) AS n, avg(s) + 2 * stddev_pop(s) AS lim FROM d GROUP BY user_id)
SELECT d.user_id, any_value(n) AS n_samples, count(*) FILTER (n >= 3 AND s > lim) AS change_points
FROM d JOIN l USING (user_id) GROUP BY d.user_id"""
)
def change_points(spark, sf_dir):
    return win.change_points(node_sequence(spark, sf_dir, "value"), NODE, "value")


@query(
    """SELECT event_id, user_id, round(CASE WHEN stddev_pop(value) OVER w > 1e-12
  THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 6) AS z
FROM events WINDOW w AS (PARTITION BY user_id)"""
)
def zscore_normalize(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("event_id", "user_id", "value")
    return win.zscore(ev, NODE, "value").select("event_id", "user_id", r6("z").alias("z"))


@query(
    """SELECT event_id, user_id, round(CASE WHEN max(value) OVER w > min(value) OVER w
  THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS scaled
FROM events WINDOW w AS (PARTITION BY user_id)"""
)
def minmax_normalize(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("event_id", "user_id", "value")
    return win.min_max(ev, NODE, "value").select("event_id", "user_id", r6("scaled").alias("scaled"))


@query(
    f"""WITH {EV}, m AS (SELECT *, quantile_cont(value, 0.5) OVER w AS med, list(value) OVER w AS near FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT *, 1.4826 * list_aggregate(list_transform(near, lambda x: abs(x - med)), 'median') AS sigma FROM m)
SELECT event_id, user_id, round(med, 6) AS median, round(sigma, 6) AS sigma,
  abs(value - med) > CASE WHEN sigma > 1e-15 THEN 3.0 * sigma ELSE 1e-15 END AS is_outlier,
  round(CASE WHEN abs(value - med) > CASE WHEN sigma > 1e-15 THEN 3.0 * sigma ELSE 1e-15 END
    THEN med ELSE value END, 6) AS filtered FROM s"""
)
def hampel_filter(spark, sf_dir):
    out = win.hampel(node_sequence(spark, sf_dir, "value"), NODE, "value")
    return out.select(
        "event_id", "user_id", r6("median").alias("median"), r6("sigma").alias("sigma"), "is_outlier",
        r6("filtered").alias("filtered"),
    )


@query(
    """SELECT user_id, round(coalesce(greatest(0, least(1, avg(value / 500) + 1.5 * stddev_pop(value / 500))), 0.5), 6)
  AS threshold FROM events GROUP BY user_id"""
)
def adaptive_threshold(spark, sf_dir):
    """Clipped mean plus 1.5 deviations of the finite values; .5 when there are none."""
    x = F.col("value") / 500
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    limit = sc.clamp01(F.avg(x) + 1.5 * F.stddev_pop(x))
    return (
        Tables(spark, sf_dir).events.groupBy("user_id").agg(r6(F.coalesce(limit, F.lit(0.5))).alias("threshold"))
    )


@query(
    """WITH p AS (SELECT user_id, (value * 0.6180339887 - floor(value * 0.6180339887)) * 2 * pi() - pi() AS phase FROM events)
SELECT user_id, round(atan2(sum(sin(phase)), sum(cos(phase))), 6) AS mean_phase,
  round(sqrt(sum(sin(phase))^2 + sum(cos(phase))^2) / count(*), 6) AS resultant FROM p GROUP BY user_id"""
)
def circular_mean(spark, sf_dir):
    s, c = F.sum(F.sin("phase")), F.sum(F.cos("phase"))
    return (
        samples(spark, sf_dir, "phase")
        .groupBy("user_id")
        .agg(r6(F.atan2(s, c)).alias("mean_phase"), r6(F.hypot(s, c) / F.count(F.lit(1))).alias("resultant"))
    )


@query(
    f"""WITH {EV}, t AS (SELECT *, {STEP} AS turn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT event_id, user_id, round(sum(turn) OVER (PARTITION BY user_id ORDER BY pos), 6) AS unwrapped FROM t"""
)
def phase_unwrap(spark, sf_dir):
    out = win.unwrap(node_sequence(spark, sf_dir, "phase"), NODE, "phase")
    return out.select("event_id", "user_id", r6("unwrapped").alias("unwrapped"))


EMB = """em AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS sc,
  unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def cells(spark, sf_dir):
    """Long form of the embedding frames: room, frame, subcarrier, amplitude."""
    em = Tables(spark, sf_dir).embeddings
    return em.select("label", "vec_id", F.posexplode("embedding").alias("sc", "x")).withColumn(
        "x", F.col("x").cast("double")
    )


@query(
    f"""WITH {EMB}, v AS (SELECT label, sc, coalesce(var_samp(x), 0) AS v FROM em GROUP BY label, sc)
SELECT sc, round(avg(v), 6) AS variance FROM v GROUP BY sc"""
)
def subcarrier_variance(spark, sf_dir):
    """Sample variance over time per stream and subcarrier, averaged over streams."""
    per = cells(spark, sf_dir).groupBy("label", "sc").agg(F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
    return per.groupBy("sc").agg(r6(F.avg("v")).alias("variance"))


@query(
    f"""WITH {EMB}, f AS (SELECT *, (dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS win FROM em),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY label, win, sc ORDER BY vec_id) AS d FROM f),
c AS (SELECT label, win, sc, avg(x) AS m, var_pop(x) AS v, coalesce(var_samp(x), 0) AS vs,
  coalesce(avg(abs(d)), 0) AS ad, coalesce(avg(d * d), 0) AS dd FROM d GROUP BY ALL)
SELECT label, win, round(avg(m), 6) AS mean_amplitude, round(avg(v) + var_pop(m), 6) AS amplitude_variance,
  round(avg(ad), 6) AS temporal_delta, round(avg(dd), 6) AS motion_energy,
  round(avg(vs), 6) AS subcarrier_variance FROM c GROUP BY label, win"""
)
def csi_window_features(spark, sf_dir):
    """Statistics of [16 frames, 64 subcarriers] windows per room."""
    em = Tables(spark, sf_dir).embeddings.select("label", "vec_id", "embedding")
    seq = win.tumbling(seqs.sequence(em, ["label"], ["vec_id"]), 16)
    long = seq.select("label", "win", "pos", F.posexplode("embedding").alias("sc", "x")).withColumn(
        "x", F.col("x").cast("double")
    )
    long = long.withColumn("phase", F.lit(0.0))
    out = win.window_statistics(long, ["label", "win"], ["sc"], "pos", "x", "phase")
    names = ["mean_amplitude", "amplitude_variance", "temporal_delta", "motion_energy", "subcarrier_variance"]
    return out.select("label", "win", *[r6(c).alias(c) for c in names])


@query(
    f"""WITH {EV}, s AS (SELECT user_id, amp, unnest(range(greatest(0, ceil((pos - 31) / 8.0))::BIGINT, pos // 8 + 1)) AS win FROM ev)
SELECT user_id, win, round(avg(amp), 6) AS mean_value, round(max(amp), 6) AS max_value,
  round(var_pop(amp), 6) AS var_value FROM s GROUP BY user_id, win HAVING count(*) = 32"""
)
def sliding_count_windows(spark, sf_dir):
    """Complete windows of 32 samples every 8."""
    s = win.sliding(node_sequence(spark, sf_dir, "amp"), 32, 8)
    out = s.groupBy("user_id", "win").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("amp")).alias("mean_value"),
        r6(F.max("amp")).alias("max_value"),
        r6(F.var_pop("amp")).alias("var_value"),
    )
    return out.filter("n = 32").drop("n")


@query(
    f"""WITH {EV} SELECT event_id, user_id, round(CASE WHEN event_type <> 'error' THEN amp
  ELSE avg(CASE WHEN event_type <> 'error' THEN amp END) OVER (PARTITION BY user_id) END, 6) AS imputed FROM ev"""
)
def impute_column_mean(spark, sf_dir):
    ev = samples(spark, sf_dir, "event_type", "amp")
    out = win.impute(ev, NODE, "amp", F.col("event_type") != "error")
    return out.select("event_id", "user_id", r6("imputed").alias("imputed"))


@query(
    f"""WITH {EV}, g AS (SELECT user_id, us AS t1, value AS v1, lag(us) OVER w AS t0, lag(value) OVER w AS v0 FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
k AS (SELECT *, unnest(range(ceil(t0 / 21600000000)::BIGINT, ceil(t1 / 21600000000)::BIGINT)) AS grid FROM g WHERE t1 > t0)
SELECT user_id, grid, round(v0 + (v1 - v0) * ((grid * 21600000000 - t0)::DOUBLE / (t1 - t0)), 6) AS resampled FROM k"""
)
def resample_linear(spark, sf_dir):
    """Samples every six hours by linear interpolation."""
    out = win.resample(node_sequence(spark, sf_dir, "us", "value"), NODE, "us", "value", 21_600_000_000)
    return out.select("user_id", "grid", r6("resampled").alias("resampled"))


@query(
    f"""WITH {EV}, f AS (SELECT user_id, pos // 8 AS frame, sqrt(avg(value * value)) AS e FROM ev GROUP BY ALL),
n AS (SELECT *, min(e) OVER u AS lo, max(e) OVER u AS hi FROM f WINDOW u AS (PARTITION BY user_id)),
s AS (SELECT *, CASE WHEN hi - lo <= 1e-7 THEN 0 ELSE (e - lo) / (hi - lo) END AS x FROM n),
b AS (SELECT *, x >= 0.1 AS strong FROM s),
p AS (SELECT *, greatest(CASE WHEN x >= 0.05 THEN x ELSE 0 END, CASE WHEN strong THEN 1 ELSE 0 END,
  coalesce(CASE WHEN lag(strong, 1) OVER w THEN 2 / 3.0 END, 0), coalesce(CASE WHEN lead(strong, 1) OVER w THEN 2 / 3.0 END, 0),
  coalesce(CASE WHEN lag(strong, 2) OVER w THEN 1 / 3.0 END, 0), coalesce(CASE WHEN lead(strong, 2) OVER w THEN 1 / 3.0 END, 0)) AS sup
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, frame, round(e, 6) AS energy, round(CASE WHEN hi - lo <= 1e-7 THEN CASE WHEN hi > 1e-7 THEN 1 ELSE 0 END
  ELSE 0.9 + 0.2 * least(1, greatest(0, sup)) END, 6) AS gain FROM p"""
)
def gate_spectrogram(spark, sf_dir):
    """Gain per frame of eight bins."""
    seq = node_sequence(spark, sf_dir, "value")
    frames = (
        win.tumbling(seq, 8, "frame")
        .groupBy("user_id", "frame")
        .agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("energy"))
        .withColumn("pos", F.col("frame"))
    )
    out = win.gate_frames(frames, NODE, "energy")
    return out.select("user_id", "frame", r6("energy").alias("energy"), r6("gain").alias("gain"))


@query(
    f"""WITH {EMB}, s AS (SELECT label, sc, round(var_samp(x), 9) AS score FROM em GROUP BY label, sc),
r AS (SELECT *, row_number() OVER w - 1 AS rk, score - lag(score) OVER w AS gap FROM s
  WINDOW w AS (PARTITION BY label ORDER BY score, sc)),
t AS (SELECT *, max(gap) OVER (PARTITION BY label) AS top, min(score) OVER (PARTITION BY label) AS lo,
  max(score) OVER (PARTITION BY label) AS hi FROM r),
c AS (SELECT *, min(rk) FILTER (gap = top) OVER (PARTITION BY label) AS cut FROM t)
SELECT label, sc, rk >= cut AS sensitive,
  round(CASE WHEN rk >= cut THEN 1 + (score - lo) / (hi - lo) ELSE 0.5 END, 6) AS weight FROM c"""
)
def largest_gap_partition(spark, sf_dir):
    """Sensitive and insensitive subcarriers per room, with importance weights."""
    scores = cells(spark, sf_dir).groupBy("label", "sc").agg(r6(F.var_samp("x"), 9).alias("score"))
    out = win.largest_gap_split(scores, ["label"], "sc", "score")
    return out.select("label", "sc", "sensitive", r6("weight").alias("weight"))


@query(
    """SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"""
)
def quantile_calibration(spark, sf_dir):
    """Exact quantiles of few, very large groups."""
    ev = Tables(spark, sf_dir).events.select("event_type", "value", "event_id")
    out = quantiles(ev, ["event_type"], "value", ["event_id"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select("event_type", *[r6(c).alias(c) for c in ("p05", "p50", "p95")])


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi
  FROM events GROUP BY event_type)
SELECT event_id, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) AS scaled
FROM events JOIN q USING (event_type)"""
)
def robust_scale(spark, sf_dir):
    """Values scaled to [0, 1] between the 5th and 95th percentile of their type."""
    ev = Tables(spark, sf_dir).events.select("event_type", "value", "event_id")
    q = quantiles(ev, ["event_type"], "value", ["event_id"], {"lo": 0.05, "hi": 0.95})
    out = seqs.attach(ev, q, ["event_type"])
    scaled = sc.clamp01((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return out.select("event_id", r6(scaled).alias("scaled"))


@query(
    f"""WITH {EV}, d AS (SELECT *, pos // 16 AS win, amp - lag(amp) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM ev),
m AS (SELECT user_id, win, count(*) AS n, avg(d * d) AS energy, avg(amp) AS mean_value, var_pop(amp) AS var_value
  FROM d GROUP BY ALL),
b AS (SELECT user_id, arg_max(win, (energy, -win)) AS win FROM m WHERE win > 0 GROUP BY user_id)
SELECT e.user_id, m.win AS present_win, m.n AS present_samples, round(m.mean_value - e.mean_value, 6) AS mean_delta,
  round(m.var_value - e.var_value, 6) AS var_delta
FROM m e LEFT JOIN b USING (user_id) LEFT JOIN m ON m.user_id = b.user_id AND m.win = b.win WHERE e.win = 0"""
)
def empty_vs_present(spark, sf_dir):
    """First segment against the segment with the highest mean motion energy of the node; nulls for a node of one segment."""
    rows = win.tumbling(win.steps(node_sequence(spark, sf_dir, "amp"), NODE, "amp"), 16)
    seg = rows.groupBy("user_id", "win").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("step") * F.col("step")).alias("energy"),
        F.struct(F.avg("amp").alias("m"), F.var_pop("amp").alias("v")).alias("s"),
    )
    out = seg.groupBy("user_id").agg(
        F.max(F.when(F.col("win") == 0, F.col("s"))).alias("empty"),
        F.max_by(
            F.struct("win", "n", "s"), F.when(F.col("win") > 0, F.struct(F.col("energy"), -F.col("win")))
        ).alias("present"),
    )
    return out.select(
        "user_id", F.col("present.win").alias("present_win"), F.col("present.n").alias("present_samples"),
        r6(F.col("present.s.m") - F.col("empty.m")).alias("mean_delta"),
        r6(F.col("present.s.v") - F.col("empty.v")).alias("var_delta"),
    )


@query(
    f"""WITH {EV}, q AS (SELECT user_id, stddev_pop(amp) / avg(abs(amp)) AS cv, least(count(*) / 64.0, 1) AS fill FROM ev GROUP BY user_id),
s AS (SELECT user_id, cv, greatest(0, least(1, (CASE WHEN cv < 0.01 THEN cv / 0.01 * 0.3
  WHEN cv < 0.3 THEN 0.3 + 0.7 * greatest(0, 1 - abs((cv - 0.15) / 0.15))
  ELSE greatest(0.1, least(0.5, 1 - (cv - 0.3) / 0.7)) END) * (0.3 + 0.7 * fill))) AS score FROM q)
SELECT user_id, round(score, 6) AS score, CASE WHEN score >= 0.72 THEN 'valid' WHEN score >= 0.45 THEN 'degraded'
  WHEN score >= 0.18 THEN 'unreliable' ELSE 'unavailable' END AS quality FROM s"""
)
def signal_quality(spark, sf_dir):
    """Amplitude quality per node from the coefficient of variation and history fill."""
    out = samples(spark, sf_dir, "amp").groupBy("user_id").agg(
        (F.stddev_pop("amp") / F.avg(F.abs("amp"))).alias("cv"),
        F.least(F.count(F.lit(1)) / 64, F.lit(1.0)).alias("fill"),
    )
    score = sc.amplitude_quality(F.col("cv"), F.col("fill"))
    out = out.select("user_id", score.alias("score"))
    return out.select("user_id", r6("score").alias("score"), sc.confidence_status("score").alias("quality"))
