"""Hysteresis, gates, trends and other state along a node."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import phase as ph
from rippleframe.functions import scoring as sc
from rippleframe.operators import longitudinal, scans
from rippleframe.operators import sequence as seqs
from rippleframe.operators import windows as win
from rippleframe.plans.registry import Tables, query, r6
from rippleframe.plans.windows import CLAMP, EV, NODE, STATS, _window_stats, node_sequence, samples

STREAK = """f AS (SELECT *, max(CASE WHEN NOT hit THEN pos END) OVER w AS miss, max(CASE WHEN hit THEN pos END) OVER w AS seen FROM h
  WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT *, pos - coalesce(miss, -1) AS on_run, pos - coalesce(seen, -1) AS off_run FROM f)"""


@query(
    f"""WITH {EV}, h AS (SELECT *, value > 40 AS hit FROM ev), {STREAK},
s AS (SELECT *, CASE WHEN on_run >= 2 THEN true WHEN off_run >= 2 THEN false END AS sw FROM g)
SELECT event_id, user_id, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos), false) AS state FROM s"""
)
def debounce_islands(spark, sf_dir):
    """Detection (value above 40) confirmed and released after two samples in a row."""
    seq = node_sequence(spark, sf_dir, "value").withColumn("hit", F.col("value") > 40)
    return scans.debounce(seq, NODE, "hit").select("event_id", "user_id", "state")


@query(
    f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, pos, event_id, 0.5 * least(1, value / 103) AS s FROM ev WHERE pos = 0
  UNION ALL SELECT e.user_id, e.pos, e.event_id, 0.5 * r.s + 0.5 * least(1, e.value / 103) FROM r
  JOIN ev e ON e.user_id = r.user_id AND e.pos = r.pos + 1)
SELECT event_id, user_id, round(s, 6) AS smoothed FROM r"""
)
def debounce_score(spark, sf_dir):
    """Smoothed detection confidence of the debouncer, starting at zero."""
    seq = node_sequence(spark, sf_dir, "value")
    out = scans.smooth(seq, NODE, sc.clamp01(F.col("value") / 103), 0.5, "smoothed", seed=False)
    return out.select("event_id", "user_id", r6("smoothed").alias("smoothed"))


@query(
    f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, pos, event_id, 0.0::DOUBLE AS res, amp AS ema FROM ev WHERE pos = 0
  UNION ALL SELECT e.user_id, e.pos, e.event_id, e.amp - r.ema, 0.05 * e.amp + 0.95 * r.ema FROM r
  JOIN ev e ON e.user_id = r.user_id AND e.pos = r.pos + 1)
SELECT event_id, user_id, round(res, 5) AS residual FROM r"""
)
def ema_residual(spark, sf_dir):
    out = scans.ema_residual(node_sequence(spark, sf_dir, "amp"), NODE, "amp")
    return out.select("event_id", "user_id", r6("residual", 5).alias("residual"))


@query(
    f"""WITH RECURSIVE {STATS}, r AS (SELECT user_id, win, mean_amplitude AS m, temporal_delta AS d FROM stats WHERE win = 0
  UNION ALL SELECT s.user_id, s.win, 0.95 * r.m + 0.05 * s.mean_amplitude, 0.95 * r.d + 0.05 * s.temporal_delta
  FROM r JOIN stats s ON s.user_id = r.user_id AND s.win = r.win + 1)
SELECT r.user_id, r.win, round(r.m, 6) AS base_mean, round(r.d, 6) AS base_delta,
  round({CLAMP.format('avg(s.mean_amplitude) OVER w + stddev_pop(s.mean_amplitude) OVER w')}, 6) AS mean_threshold
FROM r JOIN stats s ON s.user_id = r.user_id AND s.win = r.win
WINDOW w AS (PARTITION BY r.user_id ORDER BY r.win ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)"""
)
def rolling_baseline(spark, sf_dir):
    """Exponential baseline over windows, and the threshold from the last 64 of them."""
    stats = _window_stats(spark, sf_dir).withColumn("pos", F.col("win"))
    over = lambda w: w.rowsBetween(-63, 0)
    stats = seqs.framed(
        stats,
        NODE,
        {
            "mean_threshold": lambda w: sc.clamp01(
                F.avg("mean_amplitude").over(over(w)) + F.stddev_pop("mean_amplitude").over(over(w))
            )
        },
        before=63,
    )
    out = scans.smooth(stats, NODE, F.col("mean_amplitude"), 0.05, "base_mean", seed=True)
    out = scans.smooth(out, NODE, F.col("temporal_delta"), 0.05, "base_delta", seed=True)
    return out.select("user_id", "win", *[r6(c).alias(c) for c in ("base_mean", "base_delta", "mean_threshold")])


@query(
    f"""WITH {EV}, m AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM ev GROUP BY user_id),
h AS (SELECT ev.*, abs(value - m) / s >= 0.8 AS hit FROM ev JOIN m USING (user_id)), {STREAK}
SELECT user_id, max(on_run) AS longest, count(*) FILTER (on_run = 3) AS sustained_runs FROM g GROUP BY user_id"""
)
def sustained_drift_runs(spark, sf_dir):
    """Longest run, and number of runs of at least three, of samples .8 deviations off."""
    seq = node_sequence(spark, sf_dir, "value")
    rows = win.per_key(seq, NODE, F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    rows = scans.streaks(rows, NODE, {"streak": F.abs(F.col("value") - F.col("m")) / F.col("s") >= 0.8})
    return rows.groupBy("user_id").agg(
        F.max("streak").alias("longest"), F.count_if(F.col("streak") == 3).alias("sustained_runs")
    )


DAILY = "d AS (SELECT user_id, (ts::DATE - DATE '1970-01-01')::BIGINT AS day, avg(value / 203) AS v FROM events GROUP BY ALL)"


def _daily(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("user_id", F.unix_date(F.to_date("ts")).cast("bigint").alias("day"), (F.col("value") / 203).alias("v"))
    return longitudinal.daily_values(ev, NODE, "day", "v")


@query(
    f"""WITH {DAILY}, t AS (SELECT user_id, count(*) AS n, arg_max(v, day) AS latest, avg(v) AS mean,
  coalesce(stddev_samp(v), 0) AS std, coalesce(regr_slope(v, day), 0) AS slope FROM d GROUP BY user_id)
SELECT user_id, n, round(latest, 5) AS latest, round(mean, 5) AS mean, round(std, 5) AS std, round(slope, 5) AS slope,
  CASE WHEN slope > 1e-3 THEN 'increasing' WHEN slope < -1e-3 THEN 'decreasing' ELSE 'stable' END AS direction FROM t"""
)
def trend_slope(spark, sf_dir):
    out = scans.trend(_daily(spark, sf_dir), NODE, "day", "v")
    return out.select("user_id", "n", *[r6(c, 5).alias(c) for c in ("latest", "mean", "std", "slope")], "direction")


@query(
    f"""WITH RECURSIVE {DAILY}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
r AS (SELECT user_id, i, day, 0.0::DOUBLE AS z, false AS drift, 0::BIGINT AS run, 1::BIGINT AS n, v AS mean, 0.0::DOUBLE AS m2 FROM o WHERE i = 1
  UNION ALL SELECT user_id, i, day, z, drift, CASE WHEN drift THEN run + 1 ELSE 0 END,
    CASE WHEN drift THEN n ELSE n + 1 END, CASE WHEN drift THEN mean ELSE mean + (v - mean) / (n + 1) END,
    CASE WHEN drift THEN m2 ELSE m2 + (v - mean) * (v - (mean + (v - mean) / (n + 1))) END
  FROM (SELECT *, n >= 7 AND abs(z) >= 2 AS drift FROM (SELECT o.user_id, o.i, o.day, o.v, r.run, r.n, r.mean, r.m2,
    CASE WHEN r.n >= 7 THEN (o.v - r.mean) / greatest(sqrt(r.m2 / (r.n - 1)), 1e-6) ELSE 0 END AS z
    FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)))
SELECT user_id, day, round(z, 5) AS z, drift AS is_drift, run AS sustained,
  CASE WHEN run < 3 THEN 'none' WHEN abs(z) >= 3 THEN 'alert' ELSE 'watch' END AS severity FROM r"""
)
def longitudinal_monitor(spark, sf_dir):
    out = longitudinal.monitor(_daily(spark, sf_dir), NODE, "day", "v")
    return out.select("user_id", "day", r6("z", 5).alias("z"), "is_drift", "sustained", "severity")


@query(
    f"""WITH {EV}, l AS (SELECT event_id, user_id, pos, coalesce(CASE WHEN event_type <> 'error' THEN value END, 'inf'::DOUBLE) AS x,
  amp FROM ev), p AS (SELECT *, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(amp, 1) OVER w AS a1, lag(amp, 2) OVER w AS a2
  FROM l WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT event_id, user_id, coalesce((x2 > x1 AND x1 > x) OR (a2 > a1 AND a1 > amp), false) AS deteriorating FROM p"""
)
def deteriorating_last3(spark, sf_dir):
    """Strict decline over three readings in rate (missing counts as infinite) or confidence."""
    seq = node_sequence(spark, sf_dir, "event_type", "value", "amp")
    rate = F.when(F.col("event_type") != "error", F.col("value")).otherwise(F.lit(float("inf")))
    seq = seq.withColumn("x", rate)
    falling = lambda c, w: (F.lag(c, 2).over(w) > F.lag(c, 1).over(w)) & (F.lag(c, 1).over(w) > F.col(c))
    out = seqs.framed(seq, NODE, {"deteriorating": lambda w: falling("x", w) | falling("amp", w)}, before=2)
    return out.select("event_id", "user_id", F.coalesce("deteriorating", F.lit(False)).alias("deteriorating"))


@query(
    f"""WITH {EV}, c AS (SELECT user_id, pos, value - avg(value) OVER (PARTITION BY user_id) AS c, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
z AS (SELECT *, (c >= 0) <> (lag(c) OVER (PARTITION BY user_id ORDER BY pos) >= 0) AS x FROM c)
SELECT user_id, count(*) FILTER (x) AS crossings, round(CASE WHEN any_value(n) < 3 THEN 0 ELSE count(*) FILTER (x) / (2.0 * any_value(n) / 2.0) END, 6) AS frequency
FROM z GROUP BY user_id"""
)
def zero_crossings(spark, sf_dir):
    """Sign changes around the node mean, and their frequency at 2 Hz."""
    seq = win.per_key(node_sequence(spark, sf_dir, "value"), NODE, F.avg("value").alias("m"))
    up = F.col("value") >= F.col("m")
    rows = seqs.framed(seq.withColumn("up", up), NODE, {"was": lambda w: F.lag("up").over(w)}, before=1)
    crossed = F.count_if(F.col("up") != F.col("was"))
    n = F.count(F.lit(1))
    freq = F.when(n < 3, F.lit(0.0)).otherwise(crossed / (2.0 * n / 2.0))
    return rows.groupBy("user_id").agg(crossed.alias("crossings"), r6(freq).alias("frequency"))


@query(
    f"""WITH {EV}, h AS (SELECT *, g.score >= 0.62 AND g.energy < 0.45 AS hit FROM (SELECT *,
  least(1, 0.42 * greatest(0, least(1, greatest(slope, 0) / 0.04)) + 0.33 * least(1, energy / 0.08) + 0.25 * least(1, abs(lead) / 0.12)) AS score
  FROM (SELECT event_id, user_id, pos, coalesce(amp - lag(amp) OVER (PARTITION BY user_id ORDER BY pos), 0) AS slope,
    value / 121 AS energy, phase / pi() AS lead FROM ev)) g), {STREAK}
SELECT event_id, user_id, round(score, 6) AS score, on_run AS sustained, CASE WHEN energy >= 0.45 THEN 'motion'
  WHEN on_run >= 3 AND score >= 0.62 THEN 'likely' WHEN score >= 0.38 THEN 'preparing' ELSE 'none' END AS label FROM g"""
)
def intention_score(spark, sf_dir):
    """Lead features per sample: slope of the amplitude, energy, phase lead."""
    seq = node_sequence(spark, sf_dir, "amp", "value", "phase")
    seq = win.steps(seq, NODE, "amp", "slope").withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    seq = seq.withColumn("energy", F.col("value") / 121).withColumn("lead", F.col("phase") / F.pi())
    out = scans.intention(seq, NODE, "slope", "energy", "lead")
    return out.select("event_id", "user_id", r6("score").alias("score"), "sustained", "label")


@query(
    f"""WITH {EV}, f AS (SELECT event_id, user_id, pos, 1 - value / 250 AS s, value / 200 AS nov, abs(phase) / pi() AS dr FROM ev),
c AS (SELECT *, nov < 0.95 AND dr < 0.9 AND s >= 0.85 AND nov <= 0.35 AND dr < 0.6 AS acc, nov < 0.95 AND dr < 0.9 AS cnt FROM f),
l AS (SELECT *, sum((cnt AND NOT acc)::INT) OVER w AS low FROM c WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
b AS (SELECT *, low - coalesce(last_value(CASE WHEN acc THEN low END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos), 0) AS k FROM l),
p AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY user_id ORDER BY pos), 0)::BIGINT AS stale FROM b)
SELECT event_id, user_id, stale AS stale_frames, CASE WHEN dr >= 0.9 OR nov >= 0.95 OR stale >= 200 THEN 'recalibrate' WHEN acc THEN 'accept'
  WHEN s >= 0.5 AND nov < 0.7 THEN 'predict_only' ELSE 'reject' END AS action FROM p"""
)
def coherence_gate(spark, sf_dir):
    seq = node_sequence(spark, sf_dir, "value", "phase")
    seq = (
        seq.withColumn("score", 1 - F.col("value") / 250)
        .withColumn("novelty", F.col("value") / 200)
        .withColumn("drift", F.abs("phase") / F.pi())
    )
    out = scans.gate(seq, NODE, "score", "novelty", "drift")
    return out.select("event_id", "user_id", "stale_frames", "action")


@query(
    """WITH s AS (SELECT *, CASE WHEN value > 40 THEN 'on' ELSE 'off' END AS st FROM events),
o AS (SELECT *, row_number() OVER w - 1 AS pos, lag(st) OVER w AS old, lag(event_type) OVER w AS oa FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, pos = 0 OR st <> old AS moved FROM o),
l AS (SELECT *, max(CASE WHEN moved THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY pos) AS last_changed FROM c)
SELECT event_id, user_id, st AS state, old AS old_state, last_changed FROM l WHERE moved OR event_type <> oa"""
)
def state_changes(spark, sf_dir):
    """Entity log without no-op updates; state from the value, attribute from the type."""
    seq = node_sequence(spark, sf_dir, "event_type", "us", "value")
    seq = seq.withColumn("state", F.when(F.col("value") > 40, "on").otherwise("off"))
    out = scans.state_changes(seq, NODE, "state", "event_type", "us")
    return out.select("event_id", "user_id", "state", "old_state", "last_changed")


@query(
    """WITH f AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type <> 'signup'),
s AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup')
SELECT f.event_id, f.user_id, s.event_id AS sync_id, f.us - s.us AS age_us
FROM f ASOF LEFT JOIN s ON f.user_id = s.user_id AND f.us >= s.us"""
)
def asof_sync(spark, sf_dir):
    """Latest clock sync (signup events) at or before each frame of the node."""
    rows = samples(spark, sf_dir, "event_type", "us").drop("ts")
    frames = rows.filter("event_type <> 'signup'").drop("event_type")
    syncs = rows.filter("event_type = 'signup'").withColumn("sync_us", F.col("us"))
    syncs = syncs.withColumn("sync_id", F.col("event_id"))
    out = scans.asof(frames, syncs, NODE, "us", ["event_id"], ["sync_id", "sync_us"])
    return out.select(
        "event_id", "user_id", F.col("match_sync_id").alias("sync_id"),
        (F.col("us") - F.col("match_sync_us")).alias("age_us"),
    )


COHERENCE = """z AS (SELECT label, vec_id, list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE) AS re,
  list_transform(range(33, 65), lambda i: embedding[i]::DOUBLE) AS im FROM embeddings),
p AS (SELECT *, lag(re) OVER w AS pre, lag(im) OVER w AS pim FROM z WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
u AS (SELECT label, vec_id, unnest(re) AS ar, unnest(im) AS ai, unnest(pre) AS br, unnest(pim) AS bi FROM p WHERE pre IS NOT NULL),
k AS (SELECT label, vec_id, sqrt(sum(ar * br + ai * bi)^2 + sum(ai * br - ar * bi)^2) AS z, sqrt(sum(ar * ar + ai * ai)) AS na,
  sqrt(sum(br * br + bi * bi)) AS nb, sum(sqrt(ar * ar + ai * ai) * sqrt(br * br + bi * bi)) AS w,
  sqrt(sum((sqrt(ar * ar + ai * ai) - sqrt(br * br + bi * bi))^2)) AS g FROM u GROUP BY ALL)"""


@query(
    f"""WITH {COHERENCE} SELECT label, vec_id, round(z / (na * nb), 6) AS correlation, round(1 - g / (na + nb), 6) AS magnitude,
  round(z / w, 6) AS stability, round(0.45 * z / (na * nb) + 0.35 * (1 - g / (na + nb)) + 0.20 * z / w, 6) AS score FROM k"""
)
def consecutive_coherence(spark, sf_dir):
    """Each complex frame (32 subcarriers) against the previous one of the room."""
    em = Tables(spark, sf_dir).embeddings
    z = F.zip_with(
        F.slice("embedding", 1, 32),
        F.slice("embedding", 33, 32),
        lambda r, i: F.struct(r.cast("double").alias("re"), i.cast("double").alias("im")),
    )
    seq = seqs.sequence(em.select("label", "vec_id", z.alias("z")), ["label"], ["vec_id"])
    seq = seqs.framed(seq, ["label"], {"prev": lambda w: F.lag("z").over(w)}, before=1).filter("prev IS NOT NULL")
    out = seq.select("label", "vec_id", ph.coherence("z", "prev").alias("c"))
    return out.select("label", "vec_id", *[r6(f"c.{n}").alias(n) for n in ("correlation", "magnitude", "stability", "score")])
