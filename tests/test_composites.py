import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rippleframe.functions import pose
from rippleframe.functions import scoring as sc
from rippleframe.operators import bands, formation
from rippleframe.operators import evaluation as ev
from rippleframe.operators import sequence as S
from rippleframe.operators import windows as win
from rippleframe.sources import manifests
from rippleframe.sources.hashing import blake3_batch
from rippleframe.streaming import steps


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def cvec(z):
    return F.array(*[F.struct(F.lit(float(c.real)).alias("re"), F.lit(float(c.imag)).alias("im")) for c in z])


def test_rotated_copies_fuse_to_themselves(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=6) + 1j * rng.normal(size=6)
    out = value(spark, bands.fuse_bands([cvec(z), cvec(3 * z * np.exp(0.8j))], [F.lit(1.0), F.lit(3.0)]))
    got = np.array([c.re + 1j * c.im for c in out.fused])
    assert np.allclose(got, z / np.sqrt(np.mean(np.abs(z) ** 2))) and out.coherence == pytest.approx(1)
    silent = value(spark, bands.fuse_bands([cvec(z), cvec(0 * z)], [F.lit(0.0), F.lit(0.0)]))
    assert silent.coherence == 0 and np.isfinite(silent.fused[0].re)


def test_attention_profile_is_numpy(spark):
    rng = np.random.default_rng(2)
    rows, prior = rng.normal(size=(5, 4)), np.array([1.0, 2.0, 0.0, 1.0, 4.0])
    p = prior / prior.sum()
    logits = rows @ (p @ rows) / 2 + np.log(p + 1e-12)
    w = np.exp(logits - logits.max())
    want = (w / w.sum()) @ rows
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert np.allclose(value(spark, bands.attention_profile(F.array(*[lit(r) for r in rows]), lit(prior))), want)


def test_formation_shapes(spark):
    at = lambda c: tuple(value(spark, c))
    assert at(formation.grid_offset(F.lit(4), F.lit(7), 2.0)) == (2, 2)
    assert at(formation.circle_offset(F.lit(1), F.lit(4), 3.0)) == pytest.approx((0, 3))
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    assert at(formation.toward(p(0, 0), p(3, 4), limit=1.0)) == pytest.approx((0.6, 0.8))
    assert [at(formation.serpentine(F.lit(i), 3)) for i in range(6)] == [(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1)]


def test_flock_pushes_close_peers_apart(frame):
    out = {r.id: r for r in formation.flock(frame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>"), "id", "v").collect()}
    assert out[1].vx == pytest.approx(-1.5 * 2 / 3 + 0.8) and out[2].vx == pytest.approx(1.5 * 2 / 3 - 0.8)


def test_manifests_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(e, {"val_pck": m}) for e, m in [(1, 0.5), (3, 0.9), (2, 0.9)]], "epoch long, metrics map<string,double>")
    path = str(tmp_path / "ckpt")
    manifests.write(df.withColumn("weights_path", F.concat(F.lit("w"), "epoch")), path)
    (tmp_path / "ckpt" / "bad.json").write_text("{oops\n")
    good, bad = manifests.read(spark, path, manifests.CHECKPOINT)
    best = ev.best_checkpoints(good.withColumn("m", F.col("metrics")["val_pck"]), "m", "epoch", "weights_path", 2).collect()
    assert [r.epoch for r in best] == [3, 2] and bad.count() == 1


def test_export_shapes_and_hashes(spark, tmp_path):
    doc = {"model_name": "m", "inputs": [{"name": "x", "shape": [1, 3], "dtype": "f4"}], "outputs": [{"name": "y", "shape": [1], "dtype": "f4"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    good, _ = manifests.read(spark, str(tmp_path), manifests.EXPORT)
    assert {(r.direction, r.name, tuple(r.shape)) for r in manifests.tensor_shapes(good).collect()} == {("inputs", "x", (1, 3)), ("outputs", "y", (1,))}
    assert manifests.file_hashes(spark, str(tmp_path)).first().digest == blake3_batch([(tmp_path / "m.json").read_bytes()])[0].hex()


def test_survivor_upsert():
    places = [[0, 0, 0], [1.9, 0, 0], [2.0, 0, 0], None, [1.0, 0, 0]]
    rows = pd.DataFrame({"event_id": range(5), "place": pd.Series(places, dtype=object)})
    _, out = steps.upsert_survivor(None, rows)
    assert list(zip(out["survivor"], out["is_new"])) == [(1, True), (1, False), (2, True), (3, True), (1, False)]


def test_relative_scores_against_baseline(spark):
    one = value(spark, sc.relative_increase(F.lit(1.5), F.lit(1.0), 1.0, 0.2))
    assert one == pytest.approx(0.5) and value(spark, sc.relative_increase(F.lit(0.1), F.lit(0.0), 1.0, 0.2)) == pytest.approx(0.5)
    assert math.isnan(value(spark, sc.clamp01(F.lit(float("nan")))))
    assert value(spark, sc.confidence_status(F.lit(0.45))) == "degraded"


def test_impute_and_change_points(frame):
    df = frame([("k", i, v, ok) for i, (v, ok) in enumerate([(1.0, True), (3.0, True), (99.0, False)])], "k string, i int, v double, ok boolean")
    assert [r.imputed for r in win.impute(df, ["k"], "v", F.col("ok")).orderBy("i").collect()] == [1, 3, 2]
    jump = frame([("k", i, float(v)) for i, v in enumerate([0, 0, 0, 0, 0, 0, 0, 9, 9, 9])] + [("s", 0, 1.0), ("s", 1, 9.0)], "k string, i int, v double")
    got = {r.k: r.change_points for r in win.change_points(S.sequence(jump, ["k"], ["i"]), ["k"], "v").collect()}
    assert got == {"k": 1, "s": 0}


def test_pose_functions(frame):
    joints = [(float(i), 2.0 * i, 0.9 if i % 2 == 0 else 0.1) for i in range(17)]
    joints[11] = (3.0, 4.0, 0.8)
    df = frame([(joints,), ([None] * 17,)], "p array<struct<x:double,y:double,confidence:double>>")
    a, b = df.select(
        F.size(pose.visible("p")).alias("n"), pose.bounding_box("p").alias("b"), pose.torso("p").alias("t"), pose.flat("p").alias("f"),
        pose.edges("p", [(6, 11), (0, 1)]).alias("e"),
    ).collect()
    assert a.n == 10 and tuple(a.b) == (0, 0, 16, 32) and a.t == pytest.approx(math.hypot(3, 8)) and a.e == [True, False]
    assert len(a.f) == 51 and a.f[3:6] == [1, 2, 0.1]
    assert b.n == 0 and b.b is None and b.t == 0 and b.f == [0.0] * 51 and b.e == [False, False]


def test_coherence_step_keeps_reference_on_rejection():
    rows = pd.DataFrame({"frame": range(2), "re": [[1.0, 0.0], [0.0, 1.0]], "im": [[0.0, 0.0]] * 2})
    state, out = steps.coherence_track(None, rows)
    assert out["score"][0] == 1.0 and out["stale"].tolist() == [0, 1] and state[0] == [1.0, 0.0]
    _, out = steps.coherence_track(state, pd.DataFrame({"frame": [2], "re": [[1.0, 0.0]], "im": [[0.0, 0.0]]}))
    assert out["score"][0] == 1.0 and out["stale"][0] == 0
