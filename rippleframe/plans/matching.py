"""Room and neighbour matching, localisation, fusion and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import geo
from rippleframe.operators import fusion
from rippleframe.operators import matching as match
from rippleframe.operators import sequence as seqs
from rippleframe.operators.nearest import nearest
from rippleframe.plans.registry import Tables, epoch_us, query, r6

COSINE = "sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)))"
UNNEST = "SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(
    f"""WITH e AS ({UNNEST}), f AS (SELECT label AS room, i, avg(x) AS x FROM e GROUP BY label, i),
s AS (SELECT a.vec_id, b.room, {COSINE} AS s FROM e a JOIN f b ON a.i = b.i GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, room) AS rk FROM s)
SELECT vec_id, round(greatest(s, 0), 6) AS similarity, s >= 0.75 AS matched, CASE WHEN s >= 0.75 THEN room END AS room FROM r WHERE rk = 1"""
)
def room_match(spark, sf_dir):
    """Nearest room fingerprint (mean frame of the room) by cosine, at least .75; no similarity is below 0."""
    em = Tables(spark, sf_dir).embeddings
    cells = em.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("x"))
    rooms = means.groupBy(F.col("label").cast("bigint").alias("room")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding")
    )
    out = nearest(em.select("vec_id", "embedding"), rooms, "vec_id", "room", "embedding", 1, "cosine")
    ok = F.col("score") >= 0.75
    return out.select(
        "vec_id", r6(F.greatest("score", F.lit(0.0))).alias("similarity"), ok.alias("matched"), F.when(ok, F.col("room")).alias("room")
    )


@query(
    f"""WITH e AS ({UNNEST}), s AS (SELECT a.vec_id, b.vec_id AS near_vec_id, {COSINE} AS s
  FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near_vec_id) AS rk FROM s)
SELECT vec_id, near_vec_id, round(s, 6) AS similarity, rk::INT AS rank FROM r WHERE rk <= 3"""
)
def cosine_topk(spark, sf_dir):
    em = Tables(spark, sf_dir).embeddings.select("vec_id", "embedding")
    out = nearest(em, em, "vec_id", "vec_id", "embedding", 3, "cosine", skip_self=True)
    return out.select("vec_id", "near_vec_id", r6("score").alias("similarity"), "rank")


@query(
    """WITH p AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, (s_suppkey * 37 % 101)::DOUBLE AS y FROM supplier),
s AS (SELECT a.id, b.id AS near_id, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS d FROM p a JOIN p b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, near_id) AS rk FROM s)
SELECT id, near_id, round(d, 6) AS distance, rk::INT AS rank FROM r WHERE rk <= 4"""
)
def knn_mesh(spark, sf_dir):
    """Four nearest mesh peers by distance, then id."""
    s = Tables(spark, sf_dir).supplier
    y = F.pmod(F.col("s_suppkey") * 37, F.lit(101)).cast("double")
    pts = s.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 100, y).alias("v"))
    out = nearest(pts, pts, "id", "id", "v", 4, "euclidean", skip_self=True)
    return out.select("id", "near_id", r6(-F.col("score")).alias("distance"), "rank")


@query(
    """WITH e AS (SELECT event_id, user_id % 8 AS site, event_id % 5 AS room, event_type IN ('view', 'error') AS x, epoch_us(ts) AS us,
  cos(sqrt(value)) AS a, sin(sqrt(value)) AS b FROM events),
n AS (SELECT *, sum(x::INT) OVER (PARTITION BY site ORDER BY us, event_id) AS seen FROM e),
p AS (SELECT i.site, i.event_id, o.event_id AS exit_id, o.seen, i.a * o.a + i.b * o.b AS sim FROM n i JOIN n o
  ON i.site = o.site AND NOT i.x AND o.x AND o.room <> i.room AND i.us - o.us <= 3600000000
  AND (o.us, o.event_id) < (i.us, i.event_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(sim, 12) DESC, seen) AS rk, count(*) OVER (PARTITION BY event_id) AS c FROM p)
SELECT n.event_id, n.site, coalesce(c, 0)::INT AS candidates, CASE WHEN sim >= 0.8 THEN exit_id END AS exit_id, round(greatest(coalesce(sim, 0), 0), 6) AS similarity
FROM n LEFT JOIN b ON n.event_id = b.event_id AND rk = 1 WHERE NOT n.x"""
)
def cross_room_candidates(spark, sf_dir):
    """Best open exit from another room within an hour, for every entry of a site."""
    ev = Tables(spark, sf_dir).events.select(
        "event_id", "ts", (F.col("user_id") % 8).alias("site"), (F.col("event_id") % 5).alias("room"),
        F.col("event_type").isin("view", "error").alias("is_exit"), epoch_us("ts").alias("us"),
        F.array(F.cos(F.sqrt("value")), F.sin(F.sqrt("value"))).alias("v"),
    )
    seq = seqs.sequence(ev, ["site"], ["us", "event_id"])
    out = match.entry_candidates(seq, ["site"], F.col("is_exit"), "room", "us", "event_id", "v", 3_600_000_000)
    return out.select("event_id", "site", "candidates", "exit_id", r6("similarity").alias("similarity"))


@query(
    """WITH a AS (SELECT vec_id AS i, label AS s, vec_id % 3 AS e FROM embeddings)
SELECT a.i AS anchor, (SELECT min(b.i) FROM a b WHERE b.s = a.s AND b.e <> a.e) AS positive,
  (SELECT min(b.i) FROM a b WHERE b.s <> a.s) AS negative FROM a"""
)
def contrastive_triplets(spark, sf_dir):
    em = Tables(spark, sf_dir).embeddings.select("vec_id", "label", (F.col("vec_id") % 3).alias("env"))
    return match.triplets(em, "vec_id", "label", "env")


# Sensors and ranges seen by a target: one row per line item, target at (20, 25).
RANGES = """rg AS (SELECT l_suppkey AS target, l_orderkey, l_linenumber, l_partkey, l_quantity AS x, (l_partkey % 50)::DOUBLE AS y, 1 - l_tax AS conf,
  sqrt((l_quantity - 20)^2 + (l_partkey % 50 - 25)^2) * (1 + (l_discount - 0.05) * 0.3) AS d, l_discount AS noise FROM lineitem)"""
ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]


def _ranges(spark, sf_dir):
    y = (F.col("l_partkey") % 50).cast("double")
    d = F.sqrt(F.pow(F.col("l_quantity") - 20, 2) + F.pow(y - 25, 2))
    return Tables(spark, sf_dir).lineitem.select(
        F.col("l_suppkey").alias("target"), *ORDER, F.col("l_quantity").alias("x"), y.alias("y"),
        (1 - F.col("l_tax")).alias("conf"), (d * (1 + (F.col("l_discount") - 0.05) * 0.3)).alias("d"),
        F.col("l_discount").alias("noise"),
    )


@query(
    f"""WITH {RANGES}, v AS (SELECT *, greatest(0.5, 0.1 * d)^2 AS v FROM rg),
f AS (SELECT *, first_value(x) OVER w AS x1, first_value(y) OVER w AS y1, first_value(d) OVER w AS d1, first_value(conf) OVER w AS c1, first_value(v) OVER w AS v1
  FROM v WINDOW w AS (PARTITION BY target ORDER BY l_orderkey, l_linenumber, l_partkey)),
e AS (SELECT *, 2 * (x - x1) AS ax, 2 * (y - y1) AS ay, d1 * d1 - d * d - x1 * x1 + x * x - y1 * y1 + y * y AS b, greatest(c1 * conf, 1e-6) / greatest(v1 + v, 1e-6) AS w FROM f),
s AS (SELECT target, count(*) AS n, sum(w * ax * ax) AS xx, sum(w * ax * ay) AS xy, sum(w * ay * ay) AS yy, sum(w * ax * b) AS bx, sum(w * ay * b) AS bz FROM e GROUP BY target HAVING count(*) >= 3),
p AS (SELECT target, n, (bx * yy - bz * xy) / (xx * yy - xy * xy) AS px, (bz * xx - bx * xy) / (xx * yy - xy * xy) AS py FROM s)
SELECT p.target, any_value(n) AS n, round(any_value(px), 5) AS x, round(any_value(py), 5) AS y,
  round(sqrt(avg((d - sqrt((px - rg.x)^2 + (py - rg.y)^2))^2)), 5) AS rmse FROM p JOIN rg USING (target) GROUP BY p.target"""
)
def trilaterate_2d(spark, sf_dir):
    out = fusion.trilaterate(_ranges(spark, sf_dir), ["target"], ORDER, "x", "y", "d", F.col("conf"))
    return out.select("target", "n", r6("px", 5).alias("x"), r6("py", 5).alias("y"), r6("rmse", 5).alias("rmse"))


@query(
    f"""WITH {RANGES}, r AS (SELECT target, abs(d - sqrt((20 - x)^2 + (25 - y)^2)) / greatest(0.5, 0.1 * d) AS s FROM rg)
SELECT target, count(*) AS n, count(*) FILTER (s > 0.12) AS rejected, round(sqrt(avg(s * s)), 6) AS rms, round(max(s), 6) AS worst FROM r GROUP BY target"""
)
def range_validation(spark, sf_dir):
    """Residual of every range at the known position, in deviations, against a gate."""
    rows = _ranges(spark, sf_dir)
    sigma = F.abs(F.col("d") - F.hypot(20 - F.col("x"), 25 - F.col("y"))) / geo.distance_sigma(F.col("d"))
    rows = rows.select("target", sigma.alias("s"))
    return rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") > 0.12).alias("rejected"),
        r6(F.sqrt(F.avg(F.col("s") * F.col("s")))).alias("rms"), r6(F.max("s")).alias("worst"),
    )


@query(
    f"""WITH {RANGES}, t AS (SELECT target, row_number() OVER () AS i, atan2(y - 25.3, x - 20.7) AS a FROM rg),
p AS (SELECT a.target, acos(greatest(-1, least(1, cos(a.a - b.a)))) AS d FROM t a JOIN t b ON a.target = b.target AND a.i < b.i),
m AS (SELECT target, avg(d) AS m FROM p GROUP BY target)
SELECT target, round(m, 5) AS mean_angle, round(greatest(1, abs(m / (pi() / 2) - 1) + 1), 5) AS gdop FROM m"""
)
def gdop_pairs(spark, sf_dir):
    """Mean angle over all sensor pairs around a position, without forming pairs."""
    rows = _ranges(spark, sf_dir).withColumn("a", F.atan2(F.col("y") - 25.3, F.col("x") - 20.7))
    out = fusion.mean_pair_angle(rows, ["target"], "a", ORDER)
    gdop = geo.gdop_from_angle(F.col("mean_angle"), F.col("n"))
    return out.select("target", r6("mean_angle", 5).alias("mean_angle"), r6(gdop, 5).alias("gdop"))


@query(
    """WITH t AS (SELECT c_nationkey AS nation, c_custkey AS i, c_acctbal - floor(c_acctbal / (2 * pi())) * 2 * pi() AS a FROM customer),
p AS (SELECT a.nation, a.i, min(least(abs(a.a - b.a), 2 * pi() - abs(a.a - b.a))) AS d FROM t a JOIN t b ON a.nation = b.nation AND a.i <> b.i GROUP BY ALL)
SELECT nation, count(*) AS n, round(avg(d), 6) AS diversity, round(min(d), 6) AS worst FROM p GROUP BY nation"""
)
def viewpoint_diversity(spark, sf_dir):
    """Mean distance to the nearest other viewing angle."""
    rows = Tables(spark, sf_dir).customer.select(
        F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("a")
    )
    out = fusion.nearest_angle(rows, ["nation"], "a", ["c_custkey"])
    return out.select("nation", "n", r6("diversity").alias("diversity"), r6("worst").alias("worst"))


@query(
    f"""WITH {RANGES}, r AS (SELECT target, (20.7 - x) / greatest(sqrt((20.7 - x)^2 + (25.3 - y)^2), 1e-6) AS c, (25.3 - y) / greatest(sqrt((20.7 - x)^2 + (25.3 - y)^2), 1e-6) AS s,
  1 / (0.5 + noise)^2 AS w FROM rg), f AS (SELECT target, count(*) AS n, sum(w * c * c) AS a, sum(w * c * s) AS b, sum(w * s * s) AS d FROM r GROUP BY target HAVING count(*) >= 3)
SELECT target, n, round(d / (a * d - b * b), 8) AS crb_x, round(a / (a * d - b * b), 8) AS crb_y, round(sqrt((a + d) / (a * d - b * b)), 8) AS gdop FROM f"""
)
def position_bound(spark, sf_dir):
    """Lower bound of the position error from the Fisher information."""
    out = fusion.fisher_bound(
        _ranges(spark, sf_dir), ["target"], 20.7 - F.col("x"), 25.3 - F.col("y"), 0.5 + F.col("noise")
    )
    return out.select("target", "n", *[r6(c, 8).alias(c) for c in ("crb_x", "crb_y", "gdop")])


@query(
    """WITH f AS (SELECT l_suppkey AS k, 0.05 + l_discount AS w, l_tax * 7.3 AS a FROM lineitem),
s AS (SELECT k, count(*) AS n, abs(sum(a / w) / (0.05 + sum(1 / (w * w)))) AS raw FROM f GROUP BY k HAVING count(*) >= 3),
d AS (SELECT k, n, greatest(0.1, least(9.9, raw)) AS d1 FROM s)
SELECT d.k AS link, any_value(n) AS n, round(any_value(d1), 6) AS d1, round(10 - any_value(d1), 6) AS d2, round(sqrt(avg(((2 * d1 - 10) / w - a)^2)), 5) AS residual
FROM d JOIN f USING (k) GROUP BY d.k"""
)
def fresnel_geometry(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.withColumnRenamed("l_suppkey", "link")
    out = fusion.fresnel_split(rows, ["link"], 0.05 + F.col("l_discount"), F.col("l_tax") * 7.3, 10.0)
    return out.select("link", "n", r6("d1").alias("d1"), r6("d2").alias("d2"), r6("residual", 5).alias("residual"))


@query(
    """WITH r AS (SELECT l_orderkey AS tick, (1 - l_discount * 0.731) * (1 - l_tax) / (1 + l_quantity) AS s, l_extendedprice / 1000 AS v, 1 - l_discount * 0.731 AS q FROM lineitem),
g AS (SELECT tick, count(*) AS n, sum(s) AS t FROM r GROUP BY tick)
SELECT tick, any_value(n) AS n, round(sum(s / t * v), 5) AS fused, round(sum(s / t * q), 6) AS fused_quality,
  round(CASE WHEN any_value(n) <= 1 THEN 0 ELSE -sum(s / t * ln(s / t)) / ln(any_value(n)) END, 6) AS entropy FROM r JOIN g USING (tick) GROUP BY tick"""
)
def fusion_attention(spark, sf_dir):
    """Attention over the links of a tick; one pass, no join back to the rows."""
    quality = 1 - F.col("l_discount") * 0.731
    score = fusion.attention_score(quality, 1 - F.col("l_tax"), F.col("l_quantity"))
    rows = Tables(spark, sf_dir).lineitem.withColumnRenamed("l_orderkey", "tick")
    out = fusion.fuse_attention(rows, ["tick"], score, F.col("l_extendedprice") / 1000, quality)
    return out.select("tick", "n", r6("fused", 5).alias("fused"), r6("fused_quality").alias("fused_quality"), r6("entropy").alias("entropy"))


@query(
    """WITH r AS (SELECT l_orderkey AS k, l_quantity AS x, (l_partkey % 50)::DOUBLE AS y, 0.5 + l_discount * 7.31 AS h, 1 - l_tax AS c,
  CASE l_returnflag WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.6 ELSE 1.0 END AS src FROM lineitem),
w AS (SELECT *, src * c / ((2 * h * h + (1.5 * h)^2) / 3) AS w FROM r)
SELECT k AS track, count(*) AS n, round(sum(w * x) / sum(w), 5) AS x, round(sum(w * y) / sum(w), 5) AS y,
  round(CASE WHEN count(*) = 1 THEN max(h) ELSE sqrt(1 / sum(w)) END, 6) AS sigma,
  round(CASE WHEN count(*) = 1 THEN max(c) ELSE least(0.99, sum(w * c) / sum(w) + 0.02) END, 6) AS confidence FROM w GROUP BY k"""
)
def position_fusion(spark, sf_dir):
    y = (F.col("l_partkey") % 50).cast("double")
    src = F.when(F.col("l_returnflag") == "A", geo.SOURCE_WEIGHTS["range_constraint"]).when(
        F.col("l_returnflag") == "N", geo.SOURCE_WEIGHTS["depth_estimation"]
    ).otherwise(geo.SOURCE_WEIGHTS["fused"])
    rows = Tables(spark, sf_dir).lineitem.select(
        F.col("l_orderkey").alias("track"), F.col("l_quantity").alias("x"), y.alias("y"), src.alias("src"),
        (0.5 + F.col("l_discount") * 7.31).alias("h"), (1 - F.col("l_tax")).alias("c"),
    )
    out = fusion.fuse_positions(rows, ["track"], "x", "y", F.col("src"), F.col("h"), 1.5 * F.col("h"), F.col("c"))
    return out.select("track", "n", r6("x", 5).alias("x"), r6("y", 5).alias("y"), r6("sigma").alias("sigma"), r6("confidence").alias("confidence"))


POLYGON = [(10.0, 5.0), (40.0, 8.0), (45.0, 40.0), (25.0, 30.0), (8.0, 42.0)]
_EDGES = " + ".join(
    f"(({y1} > y) <> ({y2} > y) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1})::INT"
    for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1])
)


@query(
    f"""WITH p AS (SELECT c_custkey, (c_custkey % 53)::DOUBLE + 0.013 AS x, c_acctbal / 200 AS y FROM customer)
SELECT c_custkey, x BETWEEN 5 AND 30 AND y BETWEEN 5 AND 30 AS in_rect, sqrt((x - 25)^2 + (y - 25)^2) <= 12 AS in_circle,
  ({_EDGES}) % 2 = 1 AS in_polygon FROM p"""
)
def zone_contains(spark, sf_dir):
    """Membership of points in three fixed zones."""
    p = Tables(spark, sf_dir).customer.select(
        "c_custkey", ((F.col("c_custkey") % 53).cast("double") + 0.013).alias("x"), (F.col("c_acctbal") / 200).alias("y")
    )
    x, y = F.col("x"), F.col("y")
    return p.select(
        "c_custkey", geo.in_rectangle(x, y, 5, 5, 30, 30).alias("in_rect"), geo.in_circle(x, y, 25, 25, 12).alias("in_circle"),
        geo.in_polygon(x, y, POLYGON).alias("in_polygon"),
    )


@query(
    """SELECT event_id, round(power(10, (-30 + value / 5) / 30.0), 6) AS rssi_m, round(value * 1e-9 * 299792458.0 / 2, 6) AS toa_m FROM events"""
)
def range_distances(spark, sf_dir):
    """Distance from signal strength (dBm) and from round-trip time (ns)."""
    ev = Tables(spark, sf_dir).events
    return ev.select(
        "event_id", r6(geo.rssi_to_distance(-(F.col("value") / 5))).alias("rssi_m"), r6(geo.toa_to_distance("value")).alias("toa_m")
    )


@query(
    """WITH r AS (SELECT l_orderkey AS event, s_suppkey AS drone, s_acctbal / 100 AS dx, (s_suppkey * 37 % 101)::DOUBLE AS dy, 1 - l_discount * 3 AS c, l_quantity AS x, l_tax * 100 AS y
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE 1 - l_discount * 3 >= 0.8)
SELECT event, count(*) AS views, round(sum(c * x) / sum(c), 5) AS x, round(sum(c * y) / sum(c), 5) AS y, round(sum(c * c) / sum(c), 6) AS confidence FROM r GROUP BY event HAVING count(*) >= 2"""
)
def multi_view_fusion(spark, sf_dir):
    """Confidence-weighted position over at least two drones with a known place."""
    t = Tables(spark, sf_dir)
    seen = t.lineitem.select(
        F.col("l_orderkey").alias("event"), "l_suppkey", (1 - F.col("l_discount") * 3).alias("c"),
        F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"),
    ).filter("c >= 0.8")
    known = seen.join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = F.sum("c")
    out = known.groupBy("event").agg(
        F.count(F.lit(1)).alias("views"), r6(F.sum(F.col("c") * F.col("x")) / w, 5).alias("x"),
        r6(F.sum(F.col("c") * F.col("y")) / w, 5).alias("y"), r6(F.sum(F.col("c") * F.col("c")) / w).alias("confidence"),
    )
    return out.filter("views >= 2")
