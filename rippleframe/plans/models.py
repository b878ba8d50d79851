"""Calibration, field models, graph, history, planning grid and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import phase as ph
from rippleframe.functions import vectors as vec
from rippleframe.operators import calibration as cal
from rippleframe.operators import evaluation as ev
from rippleframe.operators import fields, history
from rippleframe.operators import sequence as seqs
from rippleframe.operators.graph import Graph
from rippleframe.plans.registry import Tables, query, r6
from rippleframe.session import durable

CELLS = """ce AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS sc, unnest(embedding)::DOUBLE + 1 AS a,
  atan2(sin(unnest(embedding)::DOUBLE * 8), cos(unnest(embedding)::DOUBLE * 8)) AS p FROM embeddings),
bl AS (SELECT sc, avg(a) AS m, var_samp(a) AS v, atan2(sum(sin(p)), sum(cos(p))) AS pm, 1 - least(1, sqrt(sum(sin(p))^2 + sum(cos(p))^2) / count(*)) AS d, count(*) AS n
  FROM ce WHERE label < 5 GROUP BY sc),
oc AS (SELECT sc, count(*) FILTER (label >= 5 OR label IS NULL) AS occupied FROM ce GROUP BY sc)"""


def _frames(spark, sf_dir):
    em = Tables(spark, sf_dir).embeddings
    return em.select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + 1).alias("a"),
        F.transform("embedding", lambda x: ph.wrap(x.cast("double") * 8)).alias("p"),
    )


def _baseline(frames, empty="label < 5"):
    """Empty-room baseline from the frames that ``empty`` marks; in these queries the first five rooms are the empty ones."""
    cells = frames.select(F.expr(empty).alias("empty"), F.posexplode(F.arrays_zip("a", "p")).alias("sc", "c")).select("sc", "empty", "c.a", "c.p")
    return cal.record(cells, "sc", "a", "p", min_frames=100, empty=F.col("empty"))


@query(f"""WITH {CELLS} SELECT sc, round(m, 6) AS amplitude_mean, round(v, 6) AS amplitude_variance, round(pm, 6) AS phase_mean, round(d, 6) AS phase_dispersion, n AS frames, n >= 100 AS ready, occupied FROM bl JOIN oc USING (sc)""")
def calibration_baseline(spark, sf_dir):
    b = _baseline(_frames(spark, sf_dir))
    return b.select("sc", *[r6(c).alias(c) for c in ("amplitude_mean", "amplitude_variance", "phase_mean", "phase_dispersion")], "frames", "ready", "occupied")


@query(
    f"""WITH {CELLS}, z AS (SELECT vec_id, abs(a - m) / sqrt(greatest(v, 1e-12)) AS z, abs(atan2(sin(p - pm), cos(p - pm))) AS d FROM ce JOIN bl USING (sc)),
s AS (SELECT vec_id, quantile_cont(z, 0.5) AS zm, max(z) AS zx, quantile_cont(d, 0.5) AS dm FROM z GROUP BY vec_id)
SELECT vec_id, round(zm, 6) AS z_median, round(zx, 6) AS z_max, round(dm, 6) AS phase_drift, zm > 2 OR dm > pi() / 6 AS motion, zm > 4 OR dm > pi() / 3 AS drift,
  CASE WHEN zm > 4 OR dm > pi() / 3 THEN 'drift threshold exceeded' WHEN zm > 2 OR dm > pi() / 6 THEN 'motion or person-like deviation detected' ELSE 'within empty-room baseline' END AS reason FROM s"""
)
def calibration_deviation(spark, sf_dir):
    f = _frames(spark, sf_dir)
    out = cal.deviation(f, _baseline(f), "sc", F.col("a"), F.col("p"))
    return out.select("vec_id", *[r6(c).alias(c) for c in ("z_median", "z_max", "phase_drift")], "motion", "drift", "reason")


@query(f"""WITH {CELLS} SELECT vec_id, round(sqrt(sum(greatest(a - m, 0)^2)), 6) AS residual_norm, round(max(greatest(a - m, 0)), 6) AS residual_max FROM ce JOIN bl USING (sc) GROUP BY vec_id""")
def baseline_subtract(spark, sf_dir):
    """Amplitude above the baseline, clipped at zero."""
    f = _frames(spark, sf_dir)
    means = F.transform(F.sort_array(F.collect_list(F.struct("sc", "amplitude_mean"))), lambda c: c["amplitude_mean"])
    rows = f.withColumn("m", _baseline(f).agg(means.alias("m")).scalar())  # one value of 64 means
    rows = rows.select("vec_id", vec.subtract("a", "m").alias("r"))
    return rows.select("vec_id", r6(vec.norm("r")).alias("residual_norm"), r6(F.array_max("r")).alias("residual_max"))


@query(
    """WITH ce AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS sc, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.sc::INT AS i, b.sc::INT AS j, round(covar_samp(a.x, b.x), 8) AS value FROM ce a JOIN ce b USING (vec_id) GROUP BY ALL"""
)
def field_covariance(spark, sf_dir):
    em = Tables(spark, sf_dir).embeddings
    cov = fields.covariance(fields.outer_sums(em, "embedding", 64))
    return cov.select("i", F.col("j").cast("int").alias("j"), r6("value", 8).alias("value"))


@query()
def field_modes(spark, sf_dir):
    """Frame energy outside the four leading modes of the empty-room covariance."""
    em = Tables(spark, sf_dir).embeddings
    cov = durable(fields.covariance(fields.outer_sums(em, "embedding", 64)), "covariance")  # 4096 rows, used twice
    out = fields.perturbation(em.select("vec_id", "label", "embedding"), "embedding", cov, fields.modes(cov, 4))
    return out.select("vec_id", "label", r6("energy").alias("energy"))


def _links(spark, sf_dir):
    """Radio links from supplier pairs of coordinates; attenuation from their shipments."""
    t = Tables(spark, sf_dir)
    att = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("attenuation"))
    s = t.supplier
    k = F.col("s_suppkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"))
    links = s.select(
        F.col("s_nationkey").alias("site"), k.alias("link"),
        point(F.lit(0), k * 7 % 10).alias("tx"), point(F.lit(10), F.floor(F.abs("s_acctbal")) % 10).alias("rx"),
    )
    return links.join(att, F.col("link") == F.col("l_suppkey")).drop("l_suppkey")


@query(
    """WITH l AS (SELECT s_nationkey AS site, s_suppkey AS link, (s_suppkey * 7 % 10)::DOUBLE AS y1, (floor(abs(s_acctbal))::BIGINT % 10)::DOUBLE AS y2 FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)),
v AS (SELECT *, v AS voxel, (v % 6 + 0.5) * (10 / 6.0) AS x, (v // 6 + 0.5) * (10 / 6.0) AS y, 100 + (y2 - y1)^2 AS len2 FROM l, (SELECT unnest(range(36)) AS v)),
t AS (SELECT *, greatest(0, least(1, (x * 10 + (y - y1) * (y2 - y1)) / len2)) AS t FROM v),
d AS (SELECT *, sqrt((x - t * 10)^2 + (y - y1 - t * (y2 - y1))^2) AS d, greatest(sqrt(0.125 * sqrt(len2) / 4), 0.55 * 10 / 6.0) AS r FROM t)
SELECT site, link, voxel::INT AS voxel, round(1 - d / r, 6) AS weight FROM d WHERE d < r"""
)
def link_voxels(spark, sf_dir):
    """Voxels of a 6 x 6 grid crossed by each link."""
    w = fields.link_weights(_links(spark, sf_dir), ["site"], 6, 6, (0.0, 0.0, 10.0, 10.0))
    return w.select("site", "link", "voxel", r6("weight").alias("weight"))


@query()
def tomography(spark, sf_dir):
    """Occupancy of each site from its link attenuations."""
    w = fields.link_weights(_links(spark, sf_dir), ["site"], 6, 6, (0.0, 0.0, 10.0, 10.0))
    out = fields.reconstruct(w, ["site"], "attenuation", 36)
    return out.select("site", "voxel", r6("density").alias("density"))


def _q(v, bits):
    """SQL for one quantisation round of list column ``v`` (a CTE step)."""
    lv = (1 << bits) - 1
    return f"""list_transform({v}, lambda x: list_min({v})::FLOAT::DOUBLE + round_even((x - list_min({v})) / ((list_max({v}) - list_min({v})) / {lv}), 0) * ((list_max({v}) - list_min({v})) / {lv})::FLOAT::DOUBLE)"""


@query(
    f"""WITH o AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1 AS age FROM embeddings),
a AS (SELECT *, {_q('v', 8)} AS v8 FROM o), b AS (SELECT *, {_q('v8', 6)} AS v6 FROM a), c AS (SELECT *, {_q('v6', 3)} AS v3 FROM b),
r AS (SELECT *, CASE WHEN age < 10 THEN v8 WHEN age < 25 THEN v6 ELSE v3 END AS w, CASE WHEN age < 10 THEN 8 WHEN age < 25 THEN 6 ELSE 3 END AS bits FROM c)
SELECT vec_id, age, CASE WHEN age < 10 THEN 'hot' WHEN age < 25 THEN 'warm' ELSE 'cold' END AS tier, bits, (64 * bits // 8)::BIGINT AS packed_bytes,
  round(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2])^2)), 6) AS squared_error FROM r"""
)
def quantize_tiers(spark, sf_dir):
    """Frames of a room at 8, 6 or 3 bits by age."""
    em = Tables(spark, sf_dir).embeddings.select("label", "vec_id", "embedding")
    rows = history.tiers(seqs.sequence(em, ["label"], ["vec_id"]), ["label"], "embedding", hot=10, warm=15)
    gap = vec.total(F.zip_with("embedding", "restored", lambda x, y: (x - y) * (x - y)))
    return rows.select("vec_id", "age", "tier", "bits", history.packed_bytes(F.size("embedding"), F.col("bits")).alias("packed_bytes"), r6(gap).alias("squared_error"))


def _graph(spark, sf_dir):
    """Areas, rooms, sensors and person tracks from the star schema."""
    t = Tables(spark, sf_dir)
    nation, sup, cus = 1_000, 1_000_000_000, 2_000_000_000
    node = lambda df, i, kind, area: df.select(i.alias("id"), F.lit(kind).alias("kind"), area.alias("area"), i.alias("ord"))
    none = F.lit(None).cast("string")
    nodes = (
        node(t.region, F.col("r_regionkey").cast("bigint"), "area", none)
        .unionByName(node(t.nation, F.col("n_nationkey").cast("bigint") + nation, "room", F.col("n_regionkey").cast("string")))
        .unionByName(node(t.supplier, F.col("s_suppkey") + sup, "sensor", none))
        .unionByName(node(t.customer, F.col("c_custkey") + cus, "person_track", none))
    )
    edge = lambda df, s, d, rel, o: df.select(s.cast("bigint").alias("src"), d.cast("bigint").alias("dst"), F.lit(rel).alias("rel"), o.cast("bigint").alias("ord"))
    seen = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = (
        edge(t.nation, F.col("n_nationkey") + nation, F.col("n_regionkey"), "located_in", F.col("n_nationkey"))
        .unionByName(edge(t.supplier, F.col("s_suppkey") + sup, F.col("s_nationkey") + nation, "located_in", F.col("s_suppkey")))
        .unionByName(edge(t.customer, F.col("c_custkey") + cus, F.col("c_nationkey") + nation, "located_in", F.col("c_custkey")))
        .unionByName(edge(t.supplier, F.col("s_suppkey") + sup, F.col("s_nationkey") + nation, "observes", F.col("s_suppkey")))
        .unionByName(edge(seen, F.col("l_suppkey") + sup, F.col("o_custkey") + cus, "observes", F.col("l_orderkey")))
    )
    return Graph(nodes, edges)


NODES = """nd AS (SELECT r_regionkey::BIGINT AS id, 'area' AS kind FROM region UNION ALL SELECT n_nationkey + 1000, 'room' FROM nation
  UNION ALL SELECT s_suppkey + 1000000000, 'sensor' FROM supplier UNION ALL SELECT c_custkey + 2000000000, 'person_track' FROM customer),
eg AS (SELECT (n_nationkey + 1000)::BIGINT AS src, n_regionkey::BIGINT AS dst, 'located_in' AS rel FROM nation UNION ALL SELECT s_suppkey + 1000000000, s_nationkey + 1000, 'located_in' FROM supplier
  UNION ALL SELECT c_custkey + 2000000000, c_nationkey + 1000, 'located_in' FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_nationkey + 1000, 'observes' FROM supplier
  UNION ALL SELECT l_suppkey + 1000000000, o_custkey + 2000000000, 'observes' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {NODES} SELECT src, rel, kind AS dst_kind, count(*) AS n, min(dst) AS first_dst FROM eg JOIN nd ON dst = id GROUP BY ALL""")
def graph_neighbors(spark, sf_dir):
    """Outgoing edges per node, relation and kind of target."""
    n = _graph(spark, sf_dir).neighbors()
    return n.groupBy("src", "rel", "dst_kind").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("first_dst"))


@query(f"""WITH {NODES} SELECT dst AS container, src AS member FROM eg WHERE rel = 'located_in' AND dst IN (SELECT id FROM nd)""")
def graph_contents(spark, sf_dir):
    return _graph(spark, sf_dir).contents_of()


@query(
    f"""WITH {NODES}, d AS (SELECT src, dst, kind <> 'person_track' AS ok FROM eg JOIN nd ON dst = id WHERE rel = 'observes')
SELECT src AS sensor, count(*) FILTER (ok) AS allowed_pairs, count(*) FILTER (NOT ok) AS denied_pairs, count(DISTINCT CASE WHEN NOT ok THEN dst END) AS suppressed FROM d GROUP BY src"""
)
def privacy_rollup(spark, sf_dir):
    """Identity suppression: observations of person tracks are denied."""
    return _graph(spark, sf_dir).privacy_rollup(F.col("dst_kind") != "person_track")


@query(
    f"""WITH {NODES}, g AS (SELECT s_suppkey + 1000000000 AS id FROM supplier WHERE s_acctbal < 2000)
SELECT rel, count(*) AS edges, count(DISTINCT src) AS sources FROM eg WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g) GROUP BY rel"""
)
def graph_remove(spark, sf_dir):
    """Edges left after removing the weak sensors."""
    g = _graph(spark, sf_dir)
    gone = Tables(spark, sf_dir).supplier.filter("s_acctbal < 2000").select((F.col("s_suppkey") + 1_000_000_000).alias("id"))
    e = g.remove(gone).edges.groupBy("rel", "src").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("rel").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("sources"))


@query(
    """SELECT p_partkey AS key, arg_max(l_extendedprice, (l_quantity, l_suppkey, l_extendedprice)) AS value, max(l_quantity) AS version FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey"""
)
def gossip_merge(spark, sf_dir):
    """Last write wins by version, then origin."""
    t = Tables(spark, sf_dir)
    best = t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(
        F.max_by("l_extendedprice", F.struct("l_quantity", "l_suppkey", "l_extendedprice")).alias("value"), F.max("l_quantity").alias("version")
    )
    return best.join(t.part.select(F.col("p_partkey").alias("key")), "key", "left_semi")


GRID = """ob AS (SELECT (user_id % 20)::INT AS x, (event_id % 15)::INT AS y, value > 40 AS hit, event_type = 'view' AS scan, CASE WHEN event_type = 'click' THEN 0.62 ELSE 0.55 END AS conf FROM events),
gr AS (SELECT x, y, 1 / (1 + exp(-(ln(0.2 / 0.8) + sum(CASE WHEN hit THEN ln(conf / (1 - conf)) ELSE ln((1 - conf) / conf) END)))) AS p, least(1, 0.1 * count(*)) AS ph, bool_or(scan) AS scanned, count(*) AS n FROM ob GROUP BY x, y)"""


def _grid(spark, sf_dir):
    """Bayesian cell probabilities: a chain of updates is a sum of log odds."""
    conf = F.when(F.col("event_type") == "click", 0.62).otherwise(0.55)
    odds = F.log(conf / (1 - conf))
    cells = Tables(spark, sf_dir).events.groupBy((F.col("user_id") % 20).cast("int").alias("x"), (F.col("event_id") % 15).cast("int").alias("y"))
    return cells.agg(
        (1 / (1 + F.exp(-(F.log(F.lit(0.2 / 0.8)) + F.sum(F.when(F.col("value") > 40, odds).otherwise(-odds)))))).alias("p"),
        F.least(F.lit(1.0), 0.1 * F.count(F.lit(1))).alias("pheromone"), F.bool_or(F.col("event_type") == "view").alias("scanned"), F.count(F.lit(1)).alias("n"),
    )


@query(f"""WITH {GRID} SELECT x, y, round(p, 6) AS probability, round(ph, 6) AS pheromone, scanned FROM gr""")
def probability_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("x", "y", r6("p").alias("probability"), r6("pheromone").alias("pheromone"), "scanned")


@query(
    f"""WITH {GRID}, m AS (SELECT count(*) AS cells, round(avg(scanned::INT), 6) AS coverage, round(max(p), 6) AS top,
  CASE WHEN max(p) >= 0.9 THEN 'convergence' WHEN max(p) >= 0.7 THEN 'pursuit' ELSE 'systematic' END AS phase FROM gr),
b AS (SELECT x AS target_x, y AS target_y FROM gr ORDER BY round(p * (1 - CASE WHEN scanned THEN ph ELSE 0 END), 9) DESC, y, x LIMIT 1)
SELECT * FROM m, b"""
)
def coverage_plan(spark, sf_dir):
    """Coverage, search phase and the most promising cell."""
    g = _grid(spark, sf_dir)
    worth = r6(F.col("p") * (1 - F.when(F.col("scanned"), F.col("pheromone")).otherwise(F.lit(0.0))), 9)
    top = F.max("p")
    best = F.max_by(F.struct("x", "y"), F.struct(worth, -F.col("y"), -F.col("x")))
    out = g.agg(F.count(F.lit(1)).alias("cells"), r6(F.avg(F.col("scanned").cast("int"))).alias("coverage"), r6(top).alias("top"),
                F.when(top >= 0.9, "convergence").when(top >= 0.7, "pursuit").otherwise("systematic").alias("phase"), best.alias("b"))
    return out.select("cells", "coverage", "top", "phase", F.col("b.x").alias("target_x"), F.col("b.y").alias("target_y"))


POSE = """po AS (SELECT l_orderkey AS frame, l_linenumber - 1 AS joint, l_quantity AS px, l_discount * 100 AS py, l_quantity + (l_tax - 0.04) * 37 AS gx, l_discount * 100 + (l_partkey % 7 - 3) * 0.31 AS gy
  FROM lineitem WHERE l_returnflag <> 'R'),
bx AS (SELECT frame, greatest(sqrt((max(gx) - min(gx))^2 + (max(gy) - min(gy))^2), 1e-3) AS b FROM po GROUP BY frame),
sg AS (SELECT unnest(range(17)) AS joint, unnest([0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089])::DOUBLE AS s),
kp AS (SELECT frame, joint, sqrt((px - gx)^2 + (py - gy)^2) AS d, b, s FROM po JOIN bx USING (frame) JOIN sg USING (joint))"""


def _poses(spark, sf_dir):
    """Places in whole hundredths: a step of 31 hundredths times a whole number is divided once, so equal distances stay equal."""
    li = Tables(spark, sf_dir).lineitem
    y = F.col("l_discount") * 100
    poses = li.select(
        F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") - 1).alias("joint"), F.col("l_quantity").alias("pred_x"), y.alias("pred_y"),
        (F.col("l_quantity") + (F.col("l_tax") - 0.04) * 37).alias("gt_x"), (y + (F.col("l_partkey") % 7 - 3) * 31 / 100).alias("gt_y"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("visibility"),
    )
    return ev.score_keypoints(poses, ["frame"], "joint")


@query(
    f"""WITH {POSE} SELECT frame, count(*) AS keypoints, round(avg((d <= 0.2 * b)::INT), 6) AS pck_02, round(avg((d <= 0.5 * b)::INT), 6) AS pck_05,
  round(avg(exp(-d * d / (2 * b * b * s * s + 1e-12))), 6) AS oks FROM kp GROUP BY frame"""
)
def pck_oks(spark, sf_dir):
    m = ev.frame_metrics(_poses(spark, sf_dir), ["frame"])
    return m.select("frame", "keypoints", *[r6(c).alias(c) for c in ("pck_02", "pck_05", "oks")])


@query(f"""WITH {POSE} SELECT joint, count(*) AS n, round(avg((d <= 0.2 * b)::INT), 6) AS pck_02 FROM kp GROUP BY joint""")
def joint_pck(spark, sf_dir):
    m = ev.joint_metrics(_poses(spark, sf_dir), "joint")
    return m.select("joint", "n", r6("pck_02").alias("pck_02"))


@query(
    """WITH s AS (SELECT d.doc_id, least(1, n_chars / 4007.0) AS s, quality = 1 AS t FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT unnest(range(81)) AS k),
c AS (SELECT k, count(*) FILTER (t AND s >= k / 80.0) AS tp, count(*) FILTER (NOT t AND s >= k / 80.0) AS fp, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS n FROM s, g GROUP BY k)
SELECT round(k / 80.0, 6) AS threshold, round(fp / n, 6) AS fpr, round((p - tp) / p, 6) AS fnr, round(1 - (fp / n + (p - tp) / p) / 2, 6) AS balanced_accuracy FROM c"""
)
def threshold_sweep(spark, sf_dir):
    """Document length against the quality label at 81 thresholds."""
    t = Tables(spark, sf_dir)
    rows = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "n_chars"), "doc_id")
    out = ev.threshold_sweep(rows, F.least(F.lit(1.0), F.col("n_chars") / 4007.0), F.col("quality") == 1)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("""SELECT o_orderkey AS epoch, o_totalprice AS metric, 'ckpt/' || o_custkey AS path FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC, path LIMIT 5""")
def checkpoint_topk(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("metric"), F.concat(F.lit("ckpt/"), F.col("o_custkey").cast("string")).alias("path")
    )
    return ev.best_checkpoints(o, "metric", "epoch", "path", 5)


@query(
    """SELECT user_id, event_type, count(*) AS packets FROM events GROUP BY ALL ORDER BY packets DESC, user_id, event_type LIMIT 8"""
)
def topk_links(spark, sf_dir):
    """Eight busiest links."""
    e = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("packets"))
    return e.orderBy(F.desc("packets"), "user_id", "event_type").limit(8)


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 5) AS v FROM embeddings),
l AS (SELECT label, list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) - v[label + 1] AS loss, list_sum(list_transform(v, lambda x: CASE WHEN abs(x - 0.3) < 1 THEN 0.5 * (x - 0.3)^2 ELSE abs(x - 0.3) - 0.5 END)) / 64 AS uv FROM e)
SELECT label, round(avg(loss), 6) AS part_loss, round(avg(uv), 6) AS uv_loss, round(avg(0.3 * uv + 0.6 * loss + 0.1 * uv * uv), 6) AS total FROM l GROUP BY label"""
)
def training_losses(spark, sf_dir):
    """Part cross-entropy, smooth-L1 and weighted total per label."""
    em = Tables(spark, sf_dir).embeddings.select("label", F.transform("embedding", lambda x: x.cast("double") * 5).alias("v"))
    rows = em.select("label", ev.cross_entropy("v", F.col("label")).alias("loss"), vec.mean(F.transform("v", lambda x: ev.smooth_l1(x - 0.3))).alias("uv"))
    tot = ev.total_loss(F.col("uv"), F.col("loss"), F.col("uv") * F.col("uv"))
    return rows.groupBy("label").agg(r6(F.avg("loss")).alias("part_loss"), r6(F.avg("uv")).alias("uv_loss"), r6(F.avg(tot)).alias("total"))
