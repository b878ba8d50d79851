"""Gesture, time-difference and plausibility queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rippleframe.operators import plausibility
from rippleframe.operators import sequence as seqs
from rippleframe.operators import templates as tpl
from rippleframe.operators import windows as win
from rippleframe.plans.registry import Tables, query, r6
from rippleframe.plans.windows import EV, node_sequence

# Three template shapes of twelve samples.
SHAPES = {
    "wave": [[1.0 + 0.25 * math.sin(i * math.pi / 3)] for i in range(12)],
    "push": [[0.8 + 0.05 * i] for i in range(12)],
    "hold": [[1.05] for _ in range(12)],
}
_LISTS = ", ".join(f"({i}, [{', '.join(repr(round(x[0], 12)) for x in t)}]::DOUBLE[])" for i, t in enumerate(SHAPES.values()))


@query(
    f"""WITH RECURSIVE {EV}, w AS (SELECT user_id, pos // 12 AS win, list(amp ORDER BY pos) AS a FROM ev GROUP BY ALL),
g AS (SELECT w.*, t.k, t.b FROM w, (VALUES {_LISTS}) t(k, b) WHERE len(a) = 12),
r AS (SELECT user_id, win, k, a, b, 1 AS i, 1 AS j, [0.0] || list_transform(range(12), lambda x: 'inf'::DOUBLE) AS prev, ['inf'::DOUBLE] AS cur FROM g
  UNION ALL SELECT user_id, win, k, a, b, CASE WHEN j = 12 THEN i + 1 ELSE i END, CASE WHEN j = 12 THEN 1 ELSE j + 1 END,
    CASE WHEN j = 12 THEN nxt ELSE prev END, CASE WHEN j = 12 THEN ['inf'::DOUBLE] ELSE nxt END
  FROM (SELECT *, list_append(cur, CASE WHEN abs(i - j) <= 3 THEN abs(a[i] - b[j]) + least(prev[j + 1], cur[j], prev[j]) ELSE 'inf'::DOUBLE END) AS nxt FROM r WHERE i <= 12)),
d AS (SELECT user_id, win, k, prev[13] AS d FROM r WHERE i = 13),
s AS (SELECT user_id, win, arg_min(k, (d, k)) AS k, min(d) AS best, list_sort(list(d))[2] AS second FROM d GROUP BY ALL)
SELECT w.user_id, w.win, CASE WHEN best <= 3 THEN CASE k WHEN 0 THEN 'wave' WHEN 1 THEN 'push' ELSE 'hold' END END AS gesture, round(best, 6) AS distance,
  round(CASE WHEN best <= 3 THEN 1 - best / second ELSE 0 END, 6) AS confidence, len(a) AS samples FROM w LEFT JOIN s ON w.user_id = s.user_id AND w.win = s.win"""
)
def gesture_classify(spark, sf_dir):
    """Nearest template by banded time warping of twelve-sample windows; a shorter one has no gesture and confidence 0."""
    seq = win.tumbling(node_sequence(spark, sf_dir, "amp"), 12)
    rows = win.window_arrays(seq, ["user_id", "win"], "amp")
    shapes = {n: [[round(x[0], 12)] for x in t] for n, t in SHAPES.items()}
    whole = F.size("samples") == 12
    rows = rows.withColumn("d", F.when(whole, tpl.template_distances("samples", shapes, 1, band=3)))
    c = F.when(whole, tpl.classify("d", list(SHAPES), 3.0))
    rows = rows.select("user_id", "win", F.size("samples").cast("bigint").alias("samples"), c.alias("c"))
    return rows.select("user_id", "win", "samples", F.col("c.name").alias("gesture"), r6("c.distance").alias("distance"), F.coalesce(r6("c.confidence"), F.lit(0.0)).alias("confidence"))


APS = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0), (15.0, 40.0)]


@query()
def tdoa_positions(spark, sf_dir):
    """Position of each burst of six range differences; the source moves with the node."""
    seq = win.tumbling(node_sequence(spark, sf_dir, "value"), 6)
    x, y = 5.0 + F.col("win") % 20, 8.0 + F.col("user_id") % 17
    i, j = (F.col("pos") % 5).cast("int"), ((F.col("pos") * 2 + 1) % 5).cast("int")
    ap = lambda k: F.get(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in APS]), k)
    reach = lambda k: F.hypot(x - ap(k)["x"], y - ap(k)["y"])
    delay = (reach(i) - reach(j) + (F.col("value") - 40) * 1e-4) / tpl.RADIO_SPEED
    rows = seq.select("user_id", "win", "pos", i.alias("i"), j.alias("j"), delay.alias("t"))
    burst = rows.groupBy("user_id", "win").agg(F.sort_array(F.collect_list(F.struct("pos", "i", "j", "t"))).alias("m"))
    out = burst.select("user_id", "win", tpl.tdoa_position(F.col("m.i"), F.col("m.j"), F.col("m.t"), APS).alias("p"))
    return out.select("user_id", "win", *[r6(F.get("p", k), 3).alias(n) for k, n in enumerate(("x", "y", "residual"))])


@query(
    """WITH f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, generate_subscripts(embedding, 1) - 1 AS sc, unnest(embedding)::DOUBLE AS x, vec_id % 9 = 4 AS bad FROM (SELECT * FROM embeddings)),
o AS (SELECT label, vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings WHERE vec_id % 9 <> 4),
b AS (SELECT e.label, e.vec_id, (SELECT max(vec_id) FROM embeddings p WHERE p.label = e.label AND p.vec_id < e.vec_id AND p.vec_id % 9 <> 4) AS prev FROM embeddings e),
j AS (SELECT c.vec_id, c.bad, c.sc, abs(c.x) AS a, c.x * 8 AS p, c.x * 8 + 0.5 AS coh, abs(q.x) AS pa, q.x * 8 AS pp, b.prev FROM f c JOIN b USING (vec_id) LEFT JOIN f q ON q.vec_id = b.prev AND q.sc = c.sc),
s AS (SELECT vec_id, any_value(bad) AS bad, max(abs(a - pa) / greatest(pa, 1e-6)) AS rel, max(abs(a - pa)) AS ab, max(abs(atan2(sin(p - pp), cos(p - pp)))) / ((vec_id - any_value(prev)) * 0.01) AS sp, avg((a > 1e-6 AND coh < 0.2)::INT) AS cf FROM j GROUP BY vec_id)
SELECT vec_id, array_to_string(list_filter([CASE WHEN bad THEN 'non_finite' END, CASE WHEN NOT bad AND (rel > 4 OR ab > 5) THEN 'amplitude_jump' END, CASE WHEN NOT bad AND sp > 80 THEN 'phase_velocity' END,
  CASE WHEN NOT bad AND cf > 0.25 THEN 'coherence_conflict' END], lambda x: x IS NOT NULL), ',') AS findings, CASE WHEN NOT bad THEN round(rel, 4) END AS max_relative, CASE WHEN NOT bad THEN round(sp, 5) END AS phase_speed FROM s"""
)
def plausibility_check(spark, sf_dir):
    """Amplitude jumps, phase speed and coherence conflicts; every ninth frame has a NaN."""
    em = Tables(spark, sf_dir).embeddings
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.col("vec_id") % 9 == 4
    rows = em.select(
        "label", "vec_id", F.when(bad, F.transform(x, lambda v: F.lit(float("nan")))).otherwise(F.transform(x, F.abs)).alias("a"),
        F.transform(x, lambda v: v * 8).alias("p"), F.transform(x, lambda v: v * 8 + 0.5).alias("c"), (F.col("vec_id") * 10_000).alias("us"),
    )
    out = plausibility.check(seqs.sequence(rows, ["label"], ["vec_id"]), ["label"], "a", "p", "c", "us")
    good = F.col("finite")
    return out.select(
        "vec_id", F.array_join("findings", ",").alias("findings"), F.when(good, r6("max_relative", 4)).alias("max_relative"),
        F.when(good, r6("phase_speed", 5)).alias("phase_speed"),
    )
