"""Rates over overlapping windows and averaged spectra of whole series."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import rolling_spectra as rs
from rippleframe.plans.registry import query, r6
from rippleframe.plans.windows import EV, NODE, node_sequence


def _rolling_sql(rate: float, low: float, high: float, rows: int, step: int, first: int) -> str:
    """Rolling estimates of ``amp`` with one discrete Fourier sum per window and bin."""
    inside = f"k * {rate}::DOUBLE / size BETWEEN {low} - 1e-9 AND {high} + 1e-9"
    return f"""WITH {EV}, e AS (SELECT user_id, pos AS en FROM ev WHERE pos + 1 >= {first} AND (pos + 1 - {first}) % {step} = 0),
w AS (SELECT e.user_id, e.en, amp, pos - greatest(0, en - {rows - 1}) AS i, count(*) OVER v AS n, avg(amp) OVER v AS m, var_pop(amp) OVER v AS vp
  FROM e JOIN ev ON ev.user_id = e.user_id AND ev.pos BETWEEN e.en - {rows - 1} AND e.en WINDOW v AS (PARTITION BY e.user_id, e.en)),
t AS (SELECT user_id, en, i, n, vp, (2 ** ceil(log2(n)))::BIGINT AS size, (amp - m) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS h FROM w),
f AS (SELECT user_id, en, k, any_value(n) AS n, any_value(vp) AS vp, any_value(size) AS size, sum(h * cos(2 * pi() * k * i / size))^2 + sum(h * sin(2 * pi() * k * i / size))^2 AS p
  FROM t, (SELECT unnest(range(1, {rows})) AS k) WHERE k <= size / 2 GROUP BY user_id, en, k),
b AS (SELECT user_id, en, any_value(n) AS n, any_value(vp) AS vp, any_value(size) AS size, max(p) FILTER ({inside}) AS top, sum(p) FILTER ({inside}) AS band, sum(p) AS tot, arg_max(k, p) FILTER ({inside}) AS k0 FROM f GROUP BY ALL),
g AS (SELECT b.*, coalesce(quantile_cont(f.p, 0.5) FILTER (k * {rate}::DOUBLE / b.size BETWEEN {low} - 1e-9 AND {high} + 1e-9 AND f.p < top), any_value(band)) AS back,
  coalesce(max(f.p) FILTER (k = k0 - 1), 0) AS l, max(f.p) FILTER (k = k0) AS c, max(f.p) FILTER (k = k0 + 1) AS r FROM b JOIN f USING (user_id, en) GROUP BY ALL),
c AS (SELECT *, greatest(0, least(1, (0.65 * greatest(0, least(1, (log2(greatest(top / greatest(back, 1e-20), 1)) - 0.25) / 3)) + 0.35 * least(1, band / tot / 0.35)) * least(1, band / tot / 0.25))) AS conf,
  60 * greatest({low}, least({high}, (k0 + greatest(-1, least(1, coalesce(0.5 * (l - r) / (l - 2 * c + r), 0)))) * {rate}::DOUBLE / size)) AS hz FROM g),
s AS (SELECT *, CASE WHEN vp < 1e-14 OR conf < 0.18 THEN 'unavailable' WHEN conf >= 0.72 THEN 'valid' WHEN conf >= 0.45 THEN 'degraded' ELSE 'unreliable' END AS status FROM c),
m AS (SELECT user_id, en, median(hz) OVER (PARTITION BY user_id ORDER BY en ROWS 2 PRECEDING) AS sm FROM s WHERE status <> 'unavailable')
SELECT s.user_id, s.en AS pos, n, round(CASE WHEN status <> 'unavailable' THEN hz END, 4) AS bpm, round(CASE WHEN vp < 1e-14 THEN 0 ELSE conf END, 5) AS confidence, status, round(sm, 4) AS smoothed_bpm
FROM s LEFT JOIN m ON m.user_id = s.user_id AND m.en = s.en"""


def _rolling(spark, sf_dir, *settings):
    out = rs.rolling_rates(node_sequence(spark, sf_dir, "amp"), NODE, "amp", *settings)
    return out.select("user_id", "pos", "n", r6("bpm", 4).alias("bpm"), r6("confidence", 5).alias("confidence"), "status", r6("smoothed_bpm", 4).alias("smoothed_bpm"))


# Rate in hertz, band, samples of a window, of a step and of the first usable length.
BREATHING = (2.0, 0.1, 0.5, 60, 4, 20)
HEART = (8.0, 0.8, 2.0, 48, 16, 40)


@query(_rolling_sql(*BREATHING))
def breathing_rolling(spark, sf_dir):
    """Breathing rate over the last 30 s, every 2 s, from the first 10 s on."""
    return _rolling(spark, sf_dir, *BREATHING)


@query(_rolling_sql(*HEART))
def heart_rolling(spark, sf_dir):
    """Heart rate over the last 6 s, every 2 s, from the first 5 s on."""
    return _rolling(spark, sf_dir, *HEART)


SEGMENT = 32
WELCH = f"""{EV}, z AS (SELECT user_id, count(*) AS len FROM ev GROUP BY user_id),
e AS (SELECT user_id, pos AS en, least(len, {SEGMENT}) AS n FROM ev JOIN z USING (user_id) WHERE CASE WHEN len < {SEGMENT} THEN pos = len - 1 ELSE pos >= {SEGMENT - 1} AND (pos - {SEGMENT - 1}) % {SEGMENT // 2} = 0 END),
w AS (SELECT e.user_id, e.en, e.n, ev.pos - (e.en - e.n + 1) AS i, amp - avg(amp) OVER (PARTITION BY e.user_id, e.en) AS c FROM e JOIN ev ON ev.user_id = e.user_id AND ev.pos BETWEEN e.en - e.n + 1 AND e.en),
t AS (SELECT user_id, en, n, i, c * CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) ELSE 1 END AS h, CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) ELSE 1 END AS g FROM w),
f AS (SELECT user_id, en, n, k, (sum(h * cos(2 * pi() * k * i / n))^2 + sum(h * sin(2 * pi() * k * i / n))^2) / greatest(2 * sum(g * g), 1e-15) AS p
  FROM t, (SELECT unnest(range(0, {SEGMENT // 2 + 1})) AS k) WHERE k <= n // 2 GROUP BY ALL),
psd AS (SELECT user_id, n, k, count(*) AS segments, k * 2.0::DOUBLE / n AS hz, avg(p) AS psd FROM f GROUP BY user_id, n, k)"""


@query(f"WITH {WELCH} SELECT user_id, n, segments, round(hz, 6) AS hz, round(psd, 6) AS psd FROM psd")
def welch_psd(spark, sf_dir):
    """Power spectrum of every node at 2 Hz, averaged over segments of 16 s that overlap by half."""
    out = rs.welch(node_sequence(spark, sf_dir, "amp"), NODE, "amp", 2.0, SEGMENT)
    return out.select("user_id", F.col("n").cast("bigint").alias("n"), "segments", r6("hz").alias("hz"), r6("psd").alias("psd"))


@query(
    f"""WITH {WELCH}, b AS (SELECT user_id, arg_max(hz, psd) FILTER (i) AS hz, max(psd) FILTER (i) AS top, avg(psd) FILTER (i) AS mean, count(*) FILTER (i) AS n, sum(psd) FILTER (i) AS inside,
  arg_min(psd, hz) FILTER (i) AS l, arg_max(psd, hz) FILTER (i) AS r, sum(psd) AS tot, arg_min(psd, hz) AS f, arg_max(psd, hz) AS e, max(hz) / (count(*) - 1) AS w
  FROM (SELECT *, hz BETWEEN 0.1 AND 0.5 AS i FROM psd) GROUP BY user_id),
c AS (SELECT *, top / (mean + 1e-18) AS ratio, greatest(0, least(1, CASE WHEN n > 1 THEN (inside - (l + r) / 2) * w ELSE inside END / ((tot - (f + e) / 2) * w + 1e-18))) AS share FROM b)
SELECT user_id, round(hz * 60, 4) AS bpm, round(ratio, 5) AS peak_ratio, round(share, 5) AS energy_share,
  round(coalesce(greatest(0, least(1, 0.65 * greatest(0, least(1, (ratio - 1) / 5)) + 0.35 * share)), 0), 5) AS confidence FROM c"""
)
def welch_breathing(spark, sf_dir):
    """Strongest breathing frequency of the averaged spectrum of every node."""
    out = rs.spectrum_peak(rs.welch(node_sequence(spark, sf_dir, "amp"), NODE, "amp", 2.0, SEGMENT), NODE, 0.1, 0.5)
    return out.select("user_id", r6(F.col("hz") * 60, 4).alias("bpm"), *[r6(c, 5).alias(c) for c in ("peak_ratio", "energy_share", "confidence")])
