import math
import random

import numpy as np
import duckdb
import pytest
from pyspark.sql import functions as F

from rippleframe.plans import REGISTRY
from rippleframe.functions import triage as tr
from rippleframe.operators import calibration as cal
from rippleframe.operators import evaluation as ev
from rippleframe.operators import fields, history, plausibility, rules
from rippleframe.operators import sequence as S
from rippleframe.operators.graph import Graph


def test_calibration_fixture(frame):
    cells = [(c, float(v), 0.0) for row in [[1, 2, 3], [2, 3, 4], [3, 4, 5]] for c, v in enumerate(row)]
    out = cal.record(frame(cells, "sc int, a double, p double"), "sc", "a", "p", min_frames=3).orderBy("sc").collect()
    assert [r.amplitude_mean for r in out] == [2, 3, 4] and [r.amplitude_variance for r in out] == pytest.approx([1, 1, 1])
    assert all(r.ready for r in out) and sum(r.frames for r in out) == 9


def test_circular_mean_near_half_turn(frame):
    p = [math.pi - 0.03, -math.pi + 0.03, math.pi - 0.02, -math.pi + 0.02]
    r = cal.record(frame([(0, 1.0, x) for x in p], "sc int, a double, p double"), "sc", "a", "p").first()
    assert abs(abs(r.phase_mean) - math.pi) < 0.04 and r.phase_dispersion < 0.001 and not r.ready


def test_outer_sums_and_modes_are_numpy(frame):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) @ np.diag([3, 1, 0.5, 0.2, 0.1])
    df = frame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").repartition(5)
    cov = fields.covariance(fields.outer_sums(df, "v", 5))
    got = np.zeros((5, 5))
    for r in cov.collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, np.cov(x.T))
    m = fields.modes(cov, 2)
    w, v = np.linalg.eigh(np.cov(x.T))
    assert np.allclose([r.energy for r in m.orderBy("mode").collect()], w[::-1][:2])
    basis = v[:, ::-1][:, :2]
    r = x - x.mean(axis=0)
    want = np.linalg.norm(r - r @ basis @ basis.T, axis=1)
    energies = [e.energy for e in fields.perturbation(df, "v", cov, m).orderBy("i").collect()]
    assert np.allclose(energies, want)


def test_tomography_is_numpy(frame):
    rng = random.Random(2)
    pt = lambda x, y: (float(x), float(y), 0.0)
    links = [("s", i, pt(0, rng.uniform(0, 4)), pt(4, rng.uniform(0, 4)), rng.uniform(0, 5)) for i in range(9)]
    point = "struct<x:double,y:double,z:double>"
    w = fields.link_weights(frame(links, f"site string, link int, tx {point}, rx {point}, y double"), ["site"], 3, 3, (0.0, 0.0, 4.0, 4.0))
    a = np.zeros((9, 9))
    for r in w.collect():
        a[r.link, r.voxel] = r.weight
    assert (a > 0).any() and a.max() <= 1
    y = np.array([row[4] for row in links])
    want = np.maximum(np.linalg.solve(a.T @ a + 0.1 * np.eye(9), a.T @ y), 0)
    got = [r.density for r in fields.reconstruct(w, ["site"], "y", 9, 0.1).orderBy("voxel").collect()]
    assert np.allclose(got, want)


def test_history_tiers_fixture(frame):
    df = frame([("k", i, [0.0, i + 1.0, 3.3]) for i in range(6)], "k string, i int, v array<double>")
    out = history.tiers(S.sequence(df, ["k"], ["i"]), ["k"], "v", 4, hot=1, warm=1, bits=(8, 5, 3)).orderBy("i").collect()
    assert [r.i for r in out] == [2, 3, 4, 5]
    assert [r.tier for r in out] == ["cold", "cold", "warm", "hot"] and [r.bits for r in out] == [3, 3, 5, 8]
    for r in out:
        span = max(r.v) - min(r.v)
        assert np.abs(np.array(r.restored) - r.v).max() <= 1.6 * span / (2 ** r.bits - 1)


def graph(frame):
    nodes = frame([(1, "room", "a", 1), (2, "sensor", None, 2), (3, "person_track", None, 3), (4, "room", "a", 0)], "id long, kind string, area string, ord long")
    edges = frame([(2, 1, "observes", 1), (2, 3, "observes", 2), (3, 1, "located_in", 3)], "src long, dst long, rel string, ord long")
    return Graph(nodes, edges)


def test_graph_lookups(frame):
    g = graph(frame)
    assert {(r.sensor, r.target) for r in g.observed_by().collect()} == {(2, 1), (2, 3)}
    assert [(r.container, r.member) for r in g.contents_of().collect()] == [(1, 3)]
    assert [r.room for r in g.room_for_area("area").collect()] == [4]
    r = g.privacy_rollup(F.col("dst_kind") != "person_track").first()
    assert (r.sensor, r.allowed_pairs, r.denied_pairs, r.suppressed) == (2, 1, 1, 1)


def test_graph_changes(frame):
    g = graph(frame)
    left = g.remove(frame([(3,)], "id long"))
    assert left.nodes.count() == 3 and [(r.src, r.dst) for r in left.edges.collect()] == [(2, 1)]
    up = g.upsert(frame([(3, "person_track", "b", 9), (7, "room", "c", 10)], "id long, kind string, area string, ord long")).nodes
    assert {(r.id, r.area, r.ord) for r in up.collect()} >= {(3, "b", 3), (7, "c", 10)} and up.count() == 5
    new, refused = g.add_edges(frame([(1, 4, "adjacent", 5), (1, 99, "adjacent", 6)], "src long, dst long, rel string, ord long"))
    assert new.edges.count() == 4 and [r.dst for r in refused.collect()] == [99]
    s = frame([(3, ["e0", "e1"], [1, 99, 2])], "id long, evidence array<string>, sources array<long>")
    assert {(r.src, r.dst, r.evidence) for r in g.evidence(s).collect()} == {(3, 1, "e0"), (3, 2, "")}
    assert g.snapshot().count() == 7


def test_triage_fixture(spark, frame):
    rows = [(0.0, 0.0, "none", 0.92), (0.0, 0.0, "none", 0.12), (34.0, 118.0, "minimal", 0.9), (16.0, 80.0, "walking", 0.9), (None, None, None, 0.9), (16.0, None, "none", 0.9)]
    df = frame(rows, "b double, h double, m string, c double").withColumn("cat", tr.movement_category(F.col("m"), F.lit(False)))
    args = [F.col("b"), F.col("h"), F.col("m"), F.col("cat"), F.col("c"), F.lit(None).cast("string")]
    out = df.select(tr.status(*args).alias("s"), tr.reason(*args).alias("r")).collect()
    assert [r.s for r in out] == ["deceased", "unknown", "immediate", "minor", "unknown", "immediate"]
    assert out[2].r == "respiration 34.0 BPM above START upper bound" and out[1].r.startswith("confidence 0.12 below")
    up = spark.range(1).select(tr.upgrade(F.lit("minor")).alias("a"), tr.should_upgrade(F.lit("minor"), F.lit(True)).alias("b"), tr.escalated(F.lit(1)).alias("c")).first()
    assert (up.a, up.b, up.c) == ("delayed", True, 1)


def test_rules(frame):
    rows = [(1, "on", None, 5.0, "state"), (2, "off", "on", 50.0, "state"), (3, "off", "off", None, "ring"), (4, "on", "off", 70.0, "ring")]
    df = frame(rows, "i int, s string, o string, n double, e string")
    rs = [
        rules.Rule("a", [{"above": 10.0, "below": 60.0}]),
        rules.Rule("b", [{"event": "ring"}], ignore_first=True),
        rules.Rule("c", [{"state": "on"}], [{"not": [{"above": 60.0}]}, {"template": " Yes "}]),
        rules.Rule("d", [{"state": "on", "from": "unavailable"}, {"time": "1"}]),
        rules.Rule("e", [{"state": "on"}], enabled=False),
    ]
    got = {(r.i, r.rule_id) for r in rules.evaluate(df, rs, "s", "o", "n", "e", ["i"]).collect()}
    assert got == {(2, "a"), (4, "b"), (1, "c"), (1, "d")}


def test_plausibility_skips_bad_reference(frame):
    nan = float("nan")
    rows = [("k", 0, [1.0, 1.0], [0.0, 0.0], [0.9, 0.9]), ("k", 1, [nan, 1.0], [0.0, 0.0], [0.9, 0.9]), ("k", 2, [1.1, 9.0], [0.0, 1.0], [0.9, 0.9]), ("k", 3, [1.1, 9.0], [0.0, 1.0], [0.1, 0.1])]
    df = frame(rows, "k string, t long, a array<double>, p array<double>, c array<double>").withColumn("us", F.col("t") * 1000)
    out = plausibility.check(S.sequence(df, ["k"], ["t"]), ["k"], "a", "p", "c", "us").orderBy("t").collect()
    assert [r.findings for r in out] == [[], ["non_finite"], ["amplitude_jump", "phase_velocity"], ["coherence_conflict"]]
    assert out[2].worst == [1, 0] and out[0].valid


def test_pose_metrics_order(frame):
    rng = np.random.default_rng(3)
    gt = rng.uniform(0, 10, (17, 2))
    rows = []
    for f, noise in enumerate([0.0, 0.8, 6.0]):
        for j in range(17):
            p = gt[j] + noise * np.array([1.0, (-1.0) ** j])
            rows.append((f, j, *map(float, p), *map(float, gt[j]), 0.0 if j == 3 else 1.0))
    df = frame(rows, "f int, j int, pred_x double, pred_y double, gt_x double, gt_y double, visibility double")
    out = ev.frame_metrics(ev.score_keypoints(df, ["f"], "j"), ["f"]).orderBy("f").collect()
    assert out[0].oks > out[1].oks > out[2].oks and out[0].pck_02 == 1 > out[2].pck_02 and out[0].keypoints == 16
    seen = [j for j in range(17) if j != 3]
    s = np.hypot(*np.ptp(gt[seen], axis=0))
    want = np.mean([np.exp(-(2 * 0.64) / (2 * s * s * ev.KEYPOINT_SIGMAS[j] ** 2 + 1e-12)) for j in seen])
    assert out[1].oks == pytest.approx(want)


def test_threshold_sweep_is_brute_force(frame):
    rng = random.Random(5)
    rows = [(rng.choice([i / 20 for i in range(21)]), rng.random() < 0.4) for _ in range(60)]
    out = ev.threshold_sweep(frame(rows, "s double, t boolean"), F.col("s"), F.col("t"), steps=20).orderBy("threshold").collect()
    p, n = sum(t for _, t in rows), sum(not t for _, t in rows)
    for r in out:
        assert r.fpr == pytest.approx(sum(not t and s >= r.threshold for s, t in rows) / n)
        assert r.fnr == pytest.approx(sum(t and s < r.threshold for s, t in rows) / p)


def test_heatmap_round_trip_and_losses(spark):
    h = ev.gaussian_heatmap(F.lit(0.5), F.lit(0.25), 9)
    r = spark.range(1).select(ev.heatmap_keypoint(h, 9).alias("k"), h.alias("h")).first()
    assert (r.k.x, r.k.y) == (0.5, 0.25) and max(r.h) == 1 and min(r.h) == 0
    v = np.array([0.2, -1.0, 3.0])
    got = spark.range(1).select(ev.cross_entropy(F.array(*[F.lit(float(x)) for x in v]), F.lit(0)).alias("x"), ev.smooth_l1(F.lit(-3.0)).alias("s")).first()
    assert got.x == pytest.approx(-np.log(np.exp(v[0]) / np.exp(v).sum())) and got.s == 2.5


def test_keypoints_at_the_allowed_share_of_their_box_are_hits(spark, tmp_path):
    # Errors of -0.93 to 0.62 in y make a box of 1.55, a fifth of which is just the smallest error.
    rows = [(1, k + 1, part, 5.0, 0.03, 0.04, "N") for k, part in enumerate([0, 1, 2, 3, 4, 5])]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = REGISTRY["pck_oks"].build(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(REGISTRY["pck_oks"].sql).fetchall()
    assert [tuple(r) for r in got] == want and got[0].pck_02 == 0.5
