"""Bands, attention, smoothing, formations and other compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import geo, pose
from rippleframe.functions import triage as tr
from rippleframe.functions import vectors as vec
from rippleframe.operators import bands, formation
from rippleframe.operators import matching as match
from rippleframe.operators import sequence as seqs
from rippleframe.operators import spectral as spec
from rippleframe.operators import windows as win
from rippleframe.operators.quantiles import quantiles
from rippleframe.plans.registry import REGISTRY, Tables, epoch_us, query, r6
from rippleframe.plans.spectral import N, RATE, WINDOWED, _dft, _if_full, _length, _windows
from rippleframe.plans.windows import EV, NODE, node_sequence


@query(
    """WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS x FROM embeddings),
z AS (SELECT vec_id, j // 16 AS b, j % 8 AS k, max(x) FILTER (j % 16 < 8) AS re, max(x) FILTER (j % 16 >= 8) AS im FROM u GROUP BY ALL),
n AS (SELECT *, sqrt(avg(re * re + im * im) OVER (PARTITION BY vec_id, b)) AS s FROM z),
q AS (SELECT vec_id, b, k, re / s AS re, im / s AS im FROM n),
o AS (SELECT q.vec_id, q.b, atan2(sum(q.im * f.re - q.re * f.im), sum(q.re * f.re + q.im * f.im)) AS a FROM q JOIN q f ON f.vec_id = q.vec_id AND f.b = 0 AND f.k = q.k GROUP BY ALL),
r AS (SELECT q.vec_id, q.b, k, re * cos(a) + im * sin(a) AS re, im * cos(a) - re * sin(a) AS im FROM q JOIN o USING (vec_id, b)),
f AS (SELECT vec_id, k, sum((b + 1) / 10.0 * re) AS re, sum((b + 1) / 10.0 * im) AS im FROM r GROUP BY ALL),
p AS (SELECT x.vec_id, x.b AS b1, y.b AS b2, sqrt(sum(x.re * y.re + x.im * y.im)^2 + sum(x.im * y.re - x.re * y.im)^2) / sqrt(sum(x.re^2 + x.im^2) * sum(y.re^2 + y.im^2)) AS c
  FROM r x JOIN r y ON x.vec_id = y.vec_id AND x.k = y.k AND x.b < y.b GROUP BY ALL),
c AS (SELECT vec_id, avg(c) AS c FROM p GROUP BY vec_id)
SELECT f.vec_id, round(sqrt(sum(re * re + im * im)), 6) AS fused_norm, round(any_value(c), 6) AS coherence FROM f JOIN c USING (vec_id) GROUP BY f.vec_id"""
)
def multiband_fusion(spark, sf_dir):
    """Four bands of eight complex subcarriers, normalised, phase-aligned and weighted."""
    em = Tables(spark, sf_dir).embeddings

    def band(b):
        part = lambda at: F.slice("embedding", 16 * b + at, 8)
        return F.zip_with(part(1), part(9), lambda r, i: F.struct(r.cast("double").alias("re"), i.cast("double").alias("im")))

    out = bands.fuse_bands([band(b) for b in range(4)], [F.lit(float(b + 1)) for b in range(4)])
    norm = lambda z: F.sqrt(vec.total(F.transform(z, lambda c: c["re"] * c["re"] + c["im"] * c["im"])))
    rows = em.select("vec_id", out.alias("f"))
    return rows.select("vec_id", r6(norm(F.col("f.fused"))).alias("fused_norm"), r6("f.coherence").alias("coherence"))


@query(
    """WITH o AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 8 AS win, embedding FROM embeddings),
u AS (SELECT label, win, vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM o),
q AS (SELECT label, win, k, avg(x) AS q FROM u GROUP BY ALL), n AS (SELECT label, win, count(*) AS n FROM o GROUP BY ALL),
l AS (SELECT u.label, u.win, vec_id, sum(x * q) / 8 + ln(1.0 / any_value(n) + 1e-12) AS l FROM u JOIN q USING (label, win, k) JOIN n USING (label, win) GROUP BY ALL),
w AS (SELECT *, exp(l) / sum(exp(l)) OVER (PARTITION BY label, win) AS w FROM l),
p AS (SELECT u.label, u.win, k, sum(w * x) AS p FROM u JOIN w USING (label, win, vec_id) GROUP BY ALL)
SELECT label, win, round(sqrt(sum(p * p)), 6) AS profile_norm, round(max(p), 6) AS profile_max FROM p GROUP BY label, win"""
)
def velocity_profile(spark, sf_dir):
    """Attention-weighted profile of every eight frames of a room."""
    em = Tables(spark, sf_dir).embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = win.window_arrays(win.tumbling(seqs.sequence(em, ["label"], ["vec_id"]), 8), ["label", "win"], "v", "rows")
    rows = rows.withColumn("p", bands.attention_profile(F.col("rows")))
    return rows.select("label", "win", r6(vec.norm("p")).alias("profile_norm"), r6(F.array_max("p")).alias("profile_max"))


@query(
    f"""WITH {WINDOWED}, f AS ({_dft('t', 'h')}), p AS (SELECT user_id, win, k, x * x AS p, lag(x, 1) OVER w AS a, lead(x, 1) OVER w AS b, x FROM f WINDOW w AS (PARTITION BY user_id, win ORDER BY k)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, win ORDER BY p DESC, k) AS rank FROM p WHERE k BETWEEN 2 AND 13 AND x >= coalesce(a, 0) AND x >= b)
SELECT user_id, win, samples, rank::INT AS rank, round(k * 3.75, 4) AS bpm, round(p, 5) AS power FROM sizes LEFT JOIN (FROM r WHERE rank <= 5) USING (user_id, win)"""
)
def spectrum_peaks(spark, sf_dir):
    """Five strongest local maxima between .1 and .85 Hz per window; a window without one, or a shorter one, has one row of nulls."""
    rows = _windows(spark, sf_dir).withColumn("a", _if_full(spec.spectrum_amplitude("samples")))
    peaks = bands.band_maxima("a", RATE / N, 0.1, 0.85)
    rows = rows.select("user_id", "win", _length(), F.posexplode_outer(peaks).alias("rank", "m"))
    return rows.select("user_id", "win", "samples", (F.col("rank") + 1).alias("rank"), r6(F.col("m.hz") * 60, 4).alias("bpm"), r6("m.power", 5).alias("power"))


@query(
    f"""WITH {EV} SELECT event_id, user_id, round(avg(amp) OVER w, 6) AS mean5, round(quantile_cont(amp, 0.5) OVER w, 6) AS median5 FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def rate_smoothing(spark, sf_dir):
    """Mean and median over the last five estimates."""
    over = lambda w: w.rowsBetween(-4, 0)
    seq = seqs.framed(
        node_sequence(spark, sf_dir, "amp"), NODE,
        {"m": lambda w: F.avg("amp").over(over(w)), "l": lambda w: F.collect_list("amp").over(over(w))}, before=4,
    )
    return seq.select("event_id", "user_id", r6("m").alias("mean5"), r6(win.median_of(F.col("l"))).alias("median5"))


@query(
    f"""WITH {EV}, h AS (SELECT event_id, user_id, list(amp) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM ev),
r AS (SELECT event_id, user_id, list_reverse(l) AS l FROM h)
SELECT event_id, user_id, round(list_reduce(list_transform(range(1, len(l) + 1), lambda i: [i - 1, l[i]]),
  lambda a, b: [b[1], a[2] * (1 - 0.3 * power(0.7, b[1])) + b[2] * 0.3 * power(0.7, b[1])])[2], 6) AS smoothed FROM r"""
)
def position_smoothing(spark, sf_dir):
    """Each estimate blended with up to nineteen before it, newest first."""
    seq = seqs.framed(
        node_sequence(spark, sf_dir, "amp"), NODE, {"l": lambda w: F.collect_list("amp").over(w.rowsBetween(-19, 0))}, before=19
    )
    old = F.slice(F.reverse("l"), 2, 19)
    steps = F.transform(old, lambda v, i: F.struct(v.alias("v"), (0.3 * F.pow(F.lit(0.7), i + 1)).alias("w")))
    blended = F.aggregate(steps, F.col("amp"), lambda acc, s: acc * (1 - s["w"]) + s["v"] * s["w"])
    return seq.select("event_id", "user_id", r6(blended).alias("smoothed"))


@query(
    """SELECT event_type AS receiver, round(power(10, (-30 + quantile_cont(value, 0.5) / 5) / 30.0), 6) AS median_m, round(power(10, (-30 + quantile_cont(value, 0.9) / 5) / 30.0), 6) AS p90_m
FROM events GROUP BY event_type"""
)
def receiver_ranges(spark, sf_dir):
    """Distance of each receiver from its median and 90th percentile signal."""
    ev = Tables(spark, sf_dir).events.select(F.col("event_type").alias("receiver"), "value", "event_id")
    q = quantiles(ev, ["receiver"], "value", ["event_id"], {"m": 0.5, "p": 0.9})
    far = lambda c: r6(geo.rssi_to_distance(-F.col(c) / 5))
    return q.select("receiver", far("m").alias("median_m"), far("p").alias("p90_m"))


@query(
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state, least(count(*), 64) AS kept FROM events GROUP BY user_id"""
)
def latest_state(spark, sf_dir):
    """Latest update per node and the number kept in a history of 64."""
    when = F.struct("ts", "event_id")
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(
        F.max_by("event_id", when).alias("event_id"), F.max_by("event_type", when).alias("state"), F.least(F.count(F.lit(1)), F.lit(64)).alias("kept")
    )


@query(
    """WITH p AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, (s_suppkey * 37 % 101)::DOUBLE AS y FROM supplier),
s AS (SELECT a.id, b.id AS o, a.x, a.y, b.x AS bx, b.y AS by_, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS d FROM p a JOIN p b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS rk FROM s),
k AS (SELECT *, CASE WHEN d > 1e-6 AND d < 3 THEN (3 - d) / 3 / d ELSE 0 END AS f FROM r WHERE rk <= 7)
SELECT id, count(*) AS peers, round(1.5 * sum((x - bx) * f) + 0.8 * avg(bx - x), 5) AS vx, round(1.5 * sum((y - by_) * f) + 0.8 * avg(by_ - y), 5) AS vy FROM k GROUP BY id"""
)
def flock_velocity(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    y = F.pmod(F.col("s_suppkey") * 37, F.lit(101)).cast("double")
    out = formation.flock(s.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 100, y).alias("v")), "id", "v")
    return out.select("id", "peers", r6("vx", 5).alias("vx"), r6("vy", 5).alias("vy"))


@query(
    """WITH a AS (SELECT vec_id AS i, label AS s, vec_id % 3 AS e, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
t AS (SELECT a.i, a.v, (SELECT min(b.i) FROM a b WHERE b.s = a.s AND b.e <> a.e) AS p, (SELECT min(b.i) FROM a b WHERE b.s <> a.s) AS n FROM a)
SELECT t.i AS anchor, round(greatest(0, list_sum(list_transform(list_zip(t.v, p.v), lambda z: (z[1] - z[2])^2)) - list_sum(list_transform(list_zip(t.v, n.v), lambda z: (z[1] - z[2])^2)) + 0.2), 6) AS loss
FROM t JOIN a p ON p.i = t.p JOIN a n ON n.i = t.n"""
)
def triplet_loss(spark, sf_dir):
    """Margin loss over the deterministic triplets."""
    em = Tables(spark, sf_dir).embeddings
    t = match.triplets(em.select("vec_id", "label", (F.col("vec_id") % 3).alias("env")), "vec_id", "label", "env")
    v = lambda role: em.select(F.col("vec_id").alias(role), F.col("embedding").alias(f"_{role}"))
    rows = t.join(v("anchor"), "anchor").join(v("positive"), "positive").join(v("negative"), "negative")
    gap = lambda r: vec.total(F.zip_with("_anchor", f"_{r}", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))
    return rows.select("anchor", r6(F.greatest(F.lit(0.0), gap("positive") - gap("negative") + 0.2)).alias("loss"))


@query(
    """SELECT label, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg((abs(x) < 0.01)::INT), 6) AS sparsity
FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label"""
)
def tensor_stats(spark, sf_dir):
    x = F.col("x").cast("double")
    rows = Tables(spark, sf_dir).embeddings.select("label", F.explode("embedding").alias("x"))
    return rows.groupBy("label").agg(
        r6(F.avg(x), 8).alias("mean"), r6(F.stddev_pop(x), 8).alias("std"), r6(F.min(x)).alias("low"), r6(F.max(x)).alias("high"),
        r6(F.avg((F.abs(x) < 0.01).cast("int"))).alias("sparsity"),
    )


@query(
    """WITH n AS (SELECT o_custkey, max(epoch_us(o_orderdate)) AS last FROM orders GROUP BY o_custkey), a AS (SELECT o_custkey, (1009843200000000 - last) / 86400000000 AS days FROM n)
SELECT o_custkey AS model, CASE WHEN days <= 90 THEN 'fresh' WHEN days <= 365 THEN 'stale' ELSE 'expired' END AS status FROM a"""
)
def calibration_freshness(spark, sf_dir):
    """Age class of each model's latest calibration at the start of 2002."""
    last = Tables(spark, sf_dir).orders.groupBy(F.col("o_custkey").alias("model")).agg(F.max(epoch_us("o_orderdate")).alias("t"))
    days = (F.lit(1_009_843_200_000_000) - F.col("t")) / 86_400_000_000
    return last.select("model", F.when(days <= 90, "fresh").when(days <= 365, "stale").otherwise("expired").alias("status"))


def _plain_sql(name):
    return REGISTRY[name].sql


@query(
    f"""WITH b AS ({_plain_sql('rescue_breathing')}), m AS ({_plain_sql('movement_class')}),
j AS (SELECT m.user_id, m.win, bpm, pattern, movement, least(1, greatest(0, amplitude * regularity)) AS bc,
  CASE movement WHEN 'gross' THEN 0.9 WHEN 'fine' THEN 0.7 WHEN 'tremor' THEN 0.6 WHEN 'periodic' THEN 0.5 ELSE 0 END AS mc FROM m LEFT JOIN b USING (user_id, win)),
e AS (SELECT *, 0.5 * coalesce(bc, 0) + 0.2 * mc AS conf FROM j WHERE bpm IS NOT NULL OR movement <> 'none')
SELECT user_id, win, round(conf, 5) AS confidence, CASE WHEN pattern = 'agonal' OR bpm < 10 OR bpm > 30 THEN 'immediate' WHEN conf < 0.3 THEN 'unknown' WHEN bpm IS NULL THEN 'immediate'
  WHEN bpm NOT BETWEEN 12 AND 24 THEN CASE WHEN movement <> 'none' THEN 'delayed' ELSE 'immediate' END WHEN movement <> 'none' THEN 'minor' ELSE 'delayed' END AS condition
FROM e WHERE conf >= 0.1"""
)
def rescue_detection(spark, sf_dir):
    """Breathing, movement and ensemble of a window in one pass over its samples; short windows have movement only."""
    jump = spec.largest_step("samples")
    rows = _windows(spark, sf_dir).withColumn("a", _if_full(spec.spectrum_amplitude("samples")))
    rows = rows.withColumn("peak", spec.band_peak("a", RATE, N, 4 / 60, 40 / 60, power=False))
    est = spec.rescue_peak(F.col("peak"), "a", RATE, N, gain=7.75)
    rows = rows.select(
        "user_id", "win", *[c.alias(n) for n, c in est.items()],
        spec.movement(vec.var_pop("samples"), jump, spec.periodicity("samples")).alias("movement"),
    )
    breathing = (F.col("amplitude") >= 0.1) & (F.col("confidence") >= 0.3)
    rows = rows.select(
        "user_id", "win", "movement", F.when(breathing, r6("bpm", 5)).alias("bpm"),
        F.when(breathing, spec.breathing_type(F.col("bpm"), F.col("regularity"))).alias("pattern"),
        F.when(breathing, F.least(F.lit(1.0), r6("amplitude", 5) * r6("regularity", 5))).alias("bc"),
    ).filter("bpm IS NOT NULL OR movement <> 'none'")
    conf = tr.ensemble(F.col("bc"), F.lit(None).cast("double"), tr.lookup(F.col("movement"), tr.MOVEMENT_CONFIDENCE))
    rows = rows.withColumn("conf", conf).filter("conf >= 0.1")
    kind = tr.detected_condition(F.col("bpm"), F.coalesce("pattern", F.lit("")), F.lit(False), F.col("movement") != "none", F.col("conf"))
    return rows.select("user_id", "win", r6("conf", 5).alias("confidence"), kind.alias("condition"))


@query(
    """WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
j AS (SELECT vec_id, k // 3 AS j, max(x) FILTER (k % 3 = 0) AS x, max(x) FILTER (k % 3 = 1) AS y, max(x) FILTER (k % 3 = 2) + 0.5 AS c FROM p WHERE k < 51 GROUP BY ALL),
b AS (SELECT vec_id, count(*) AS visible, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM j WHERE c >= 0.5 GROUP BY vec_id)
SELECT b.vec_id, visible, round(b.w, 6) AS width, round(b.h, 6) AS height, round(CASE WHEN h.c >= 0.5 AND s.c >= 0.5 THEN sqrt((h.x - s.x)^2 + (h.y - s.y)^2) ELSE 0 END, 6) AS torso
FROM b JOIN j h ON h.vec_id = b.vec_id AND h.j = 11 JOIN j s ON s.vec_id = b.vec_id AND s.j = 6"""
)
def pose_boxes(spark, sf_dir):
    """Bounding box and torso of a pose read from 17 triples of each frame."""
    em = Tables(spark, sf_dir).embeddings
    part = lambda i, o: F.element_at("embedding", 3 * i + o).cast("double")
    joints = F.transform(
        F.sequence(F.lit(0), F.lit(16)),
        lambda i: F.struct(part(i, 1).alias("x"), part(i, 2).alias("y"), (part(i, 3) + 0.5).alias("confidence")),
    )
    rows = em.select("vec_id", joints.alias("p"))
    rows = rows.select("vec_id", F.size(pose.visible("p")).cast("bigint").alias("visible"), pose.bounding_box("p").alias("b"), pose.torso("p").alias("t"))
    return rows.filter("visible > 0").select("vec_id", "visible", r6("b.w").alias("width"), r6("b.h").alias("height"), r6("t").alias("torso"))
