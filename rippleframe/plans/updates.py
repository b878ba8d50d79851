"""Updates of every packet family in one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.plans.codecs import _I8, _datagrams
from rippleframe.plans.registry import query, r6
from rippleframe.sources import packets, updates

_CLAMP = "greatest(0, least(1, {}))"
_LAST = "(PARTITION BY node, k ORDER BY event_id ROWS {} PRECEDING)"


@query(
    f"""WITH p AS (SELECT event_id, event_type AS t, user_id % 256 AS node, round(value * 100)::BIGINT AS c, floor(value) / 4 AS q FROM events),
b AS (SELECT event_id, node, c, k, (c * (2 * k + 1) + 62 * k) % 256 AS x, (c * (2 * k + 2) + 62 * k + 31) % 256 AS y FROM p, (SELECT unnest(range(6)) AS k) WHERE t = 'view'),
z AS (SELECT event_id, node, c, k, {_I8.format('x')} AS re, {_I8.format('y')} AS im FROM b),
a AS (SELECT event_id, node, c, k, sqrt(re * re + im * im) AS amp, atan2(im, re) AS ph FROM z),
d AS (SELECT *, amp - lag(amp) OVER w AS d, ph - lag(ph) OVER w AS turn FROM a WINDOW w AS (PARTITION BY node, k ORDER BY event_id)),
u AS (SELECT *, sum(CASE WHEN turn IS NULL THEN ph WHEN abs(turn) < pi() THEN turn ELSE ((turn + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi() END) OVER (PARTITION BY node, k ORDER BY event_id) AS phu FROM d),
r AS (SELECT event_id, node, k, c, amp, count(*) OVER w16 AS n, avg(amp) OVER w16 AS m, var_pop(amp) OVER w16 AS v, coalesce(var_samp(amp) OVER w16, 0) AS vs, var_pop(phu) OVER w16 AS pv,
  coalesce(avg(abs(d)) OVER w15, 0) AS ad, coalesce(avg(d * d) OVER w15, 0) AS dd, avg(-(c % 90)) OVER w16 AS rssi
  FROM u WINDOW w16 AS {_LAST.format(15)}, w15 AS {_LAST.format(14)}),
f AS (SELECT event_id, node, any_value(n) AS n, any_value(rssi) AS rssi, avg(amp) AS level, avg(m) AS mean, avg(v) + var_pop(m) AS av, avg(ad) AS td, avg(dd) AS me, avg(pv) AS pv, avg(vs) AS sv FROM r GROUP BY event_id, node),
g AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY event_id) AS i, abs(level - lag(level) OVER (PARTITION BY node ORDER BY event_id)) AS s FROM f),
h AS (SELECT event_id, avg(s) OVER w AS sm, stddev_pop(s) OVER w AS ss FROM g WINDOW w AS (PARTITION BY node ORDER BY event_id ROWS 14 PRECEDING)),
j AS (SELECT g.event_id, CASE WHEN any_value(g.n) >= 3 THEN count(*) FILTER (o.s > h.sm + 2 * h.ss + 1e-9) ELSE 0 END AS cp FROM g JOIN h USING (event_id) JOIN g o ON o.node = g.node AND o.i BETWEEN g.i - 14 AND g.i GROUP BY g.event_id),
e AS (SELECT f.*, cp, {_CLAMP.format('td / 0.04')} AS ctd, {_CLAMP.format('av / 0.03')} AS ca, {_CLAMP.format('pv / 0.004')} AS cp2, {_CLAMP.format('sv / 0.015')} AS cs FROM f JOIN j USING (event_id)),
m AS (SELECT *, {_CLAMP.format('0.35 * ctd + 0.30 * ca + 0.20 * cp2 + 0.15 * cs')} AS motion FROM e),
x AS (SELECT *, {_CLAMP.format("0.5 * " + _CLAMP.format("(mean - 1.05) / 0.25") + " + 0.25 * ca + 0.15 * motion + 0.10 * cs")} AS pres FROM m),
s AS (SELECT *, CASE WHEN pres < 0.35 THEN 'empty' WHEN motion >= 0.45 THEN 'moving' ELSE 'still' END AS st FROM x),
v AS (SELECT event_id, (c % 8) & 1 = 1 AS pr, (c % 8) & 4 = 4 AS mo, (c % 8) & 2 = 2 AS fall, q, c FROM p WHERE t = 'error')
SELECT p.event_id, 'esp32' AS source, p.event_id AS tick, CASE WHEN t = 'purchase' THEN 'unknown magic' END AS error, CASE WHEN t <> 'purchase' THEN 'esp32-node-' || p.node END AS node_id,
  CASE t WHEN 'view' THEN 'raw_csi' WHEN 'error' THEN 'edge_vitals' WHEN 'click' THEN 'wasm_event' WHEN 'signup' THEN 'sync' ELSE 'unknown' END AS packet_type,
  round(CASE t WHEN 'view' THEN s.rssi WHEN 'error' THEN -(p.c % 90) END, 5) AS rssi_dbm,
  CASE WHEN t = 'view' THEN CASE st WHEN 'empty' THEN 'absent' WHEN 'still' THEN 'present_still' ELSE 'present_moving' END
    WHEN t = 'error' THEN CASE WHEN mo THEN 'present_moving' WHEN pr THEN 'present_still' ELSE 'absent' END ELSE 'absent' END AS motion_level,
  CASE WHEN t = 'view' THEN st <> 'empty' WHEN t = 'error' THEN pr ELSE false END AS presence,
  round(CASE WHEN t = 'view' THEN pres WHEN t = 'error' THEN {_CLAMP.format('p.q / 8')} ELSE 0 END, 5) AS confidence,
  round(CASE WHEN t = 'view' THEN motion WHEN t = 'error' THEN {_CLAMP.format('p.q')} END, 5) AS motion_score,
  round(mean, 5) AS mean_amplitude, round(av, 4) AS variance, round(td, 5) AS temporal_delta, round(pv, 5) AS phase_variance, round(sv, 4) AS subcarrier_variance, cp AS change_points, n AS frame_count,
  CASE WHEN t = 'error' THEN (p.c % 4000) / 100.0 END AS breathing_rate_bpm, fall AS fall_detected,
  CASE WHEN t = 'view' THEN CASE WHEN st = 'empty' THEN 0 ELSE 1 END WHEN t = 'error' THEN p.c % 4 ELSE 0 END::INT AS estimated_persons,
  CASE WHEN t = 'click' THEN p.q - p.q * 0 END AS first_event, CASE WHEN t = 'signup' THEN p.event_id END AS sequence_high_water
FROM p LEFT JOIN s USING (event_id) LEFT JOIN v ON v.event_id = p.event_id"""
)
def packet_updates(spark, sf_dir):
    """Datagrams of all families as updates of one schema; raw frames are judged over the last 16 of their node."""
    out = updates.to_updates(packets.decode(_datagrams(spark, sf_dir)), ["event_id"])
    node, f, c, v = F.get("nodes", 0), F.col("features"), F.col("classification"), F.col("vital_signs")
    rounded = {n: r6(f[n], 4 if n in ("variance", "subcarrier_variance") else 5).alias(n) for n in ("mean_amplitude", "variance", "temporal_delta", "phase_variance", "subcarrier_variance")}
    return out.select(
        "event_id", "source", "tick", "error", node["node_id"].alias("node_id"), f["packet_type"].alias("packet_type"), r6(node["rssi_dbm"], 5).alias("rssi_dbm"),
        c["motion_level"].alias("motion_level"), c["presence"].alias("presence"), r6(c["confidence"], 5).alias("confidence"), r6(c["motion_score"], 5).alias("motion_score"), *rounded.values(),
        f["change_points"].alias("change_points"), f["frame_count"].alias("frame_count"), v["breathing_rate_bpm"].alias("breathing_rate_bpm"), v["fall_detected"].alias("fall_detected"),
        "estimated_persons", F.get(f["events"], 0)["value"].alias("first_event"), f["sequence_high_water"].alias("sequence_high_water"),
    )
