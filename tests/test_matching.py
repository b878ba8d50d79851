import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rippleframe.operators import fusion, matching, templates
from rippleframe.operators import nearest as near
from rippleframe.operators import sequence as S
from rippleframe.operators.nearest import nearest
from rippleframe.streaming import steps


@pytest.mark.parametrize("block, fan_in", [(3, 64), (3, 1), (1000, 64)])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_is_brute_force(frame, monkeypatch, block, fan_in, metric):
    monkeypatch.setattr("rippleframe.operators.nearest.FAN_IN", fan_in)
    rng = np.random.default_rng(1)
    q, c = rng.integers(-2, 3, (9, 3)).astype(float), rng.integers(-2, 3, (11, 3)).astype(float)
    dq = frame([(i, v.tolist()) for i, v in enumerate(q)], "q long, v array<double>")
    dc = frame([(i, v.tolist()) for i, v in enumerate(c)], "c long, v array<double>")
    got = {}
    for r in nearest(dq, dc, "q", "c", "v", 4, metric, block=block).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.c, r.score)

    def score(a, b):
        if metric == "euclidean":
            return -math.dist(a, b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n > 1e-12 else 0.0

    for i, a in enumerate(q):
        want = sorted(((-round(score(a, b), 9), j) for j, b in enumerate(c)))[:4]
        assert [(-round(s, 9), j) for j, s in (got[i][k] for k in (1, 2, 3, 4))] == want


def test_triplets_are_brute_force(frame):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(2)) for i in range(25)]
    got = {(r.anchor, r.positive, r.negative) for r in matching.triplets(frame(rows, "i long, s int, e int"), "i", "s", "e").collect()}
    want = set()
    for i, s, e in rows:
        pos = [j for j, t, f in rows if t == s and f != e]
        neg = [j for j, t, _ in rows if t != s]
        if pos and neg:
            want.add((i, min(pos), min(neg)))
    assert got == want


@pytest.mark.parametrize("size", [1, 3, 5, 1000])
@pytest.mark.parametrize("share", [0.6, 0.07])
def test_entry_candidates_are_brute_force(frame, size, share):
    rng = random.Random(3)
    rows = [("s", t, t, rng.random() < share, rng.randrange(3), [math.cos(a), math.sin(a)]) for t in range(60) for a in [rng.uniform(0, 6)]]
    seq = S.sequence(frame(rows, "k string, t long, i long, x boolean, room int, v array<double>"), ["k"], ["t"]).withColumn("pos", F.col("pos") + 0)
    out = matching.entry_candidates(seq, ["k"], F.col("x"), "room", "t", "i", "v", 20, pending=4, size=size)
    got = {r.i: r for r in out.collect()}
    exits = []
    for _, t, i, is_exit, room, v in rows:
        if is_exit:
            exits = (exits + [(i, t, room, v)])[-4:]
            continue
        near = [(e[3][0] * v[0] + e[3][1] * v[1], -k, e[0]) for k, e in enumerate(exits) if e[2] != room and t - e[1] <= 20]
        best = max(near) if near else None
        assert got[i].candidates == len(near)
        assert got[i].exit_id == (best[2] if best and best[0] >= 0.8 else None)


def test_trilateration_recovers_a_position(frame):
    rows = [("t", i, x, y, math.hypot(3 - x, 4 - y)) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (10.0, 10.0)])]
    df = frame(rows + [("few", 0, 0.0, 0.0, 1.0)], "k string, i int, x double, y double, d double")
    out = fusion.trilaterate(df, ["k"], ["i"], "x", "y", "d", F.lit(1.0)).collect()
    assert len(out) == 1 and out[0].px == pytest.approx(3) and out[0].py == pytest.approx(4) and out[0].rmse < 1e-9


def test_pair_and_nearest_angles(frame):
    rng = random.Random(4)
    a = [rng.uniform(-9, 9) for _ in range(17)] + [1.0, 1.0]
    df = frame([("k", i, x) for i, x in enumerate(a)] + [("one", 0, 1.0)], "k string, i int, a double")
    sep = lambda x, y: math.acos(max(-1, min(1, math.cos(x - y))))
    pairs = [sep(a[i], a[j]) for i in range(19) for j in range(i)]
    got = {r.k: r for r in fusion.mean_pair_angle(df, ["k"], "a", ["i"]).collect()}
    assert got["k"].mean_angle == pytest.approx(np.mean(pairs)) and got["one"].mean_angle is None
    near = [min(sep(a[i], a[j]) for j in range(19) if j != i) for i in range(19)]
    r = fusion.nearest_angle(df, ["k"], "a", ["i"]).collect()
    assert len(r) == 1 and r[0].diversity == pytest.approx(np.mean(near), abs=1e-7) and r[0].worst == pytest.approx(min(near), abs=1e-7)


def test_attention_weights_fallback_and_bounds(frame):
    df = frame([("a", 1.0, 2.0), ("a", 3.0, 6.0), ("z", 0.0, 1.0), ("z", 0.0, 3.0), ("one", 0.4, 7.0)], "k string, s double, v double")
    got = {r.k: r for r in fusion.fuse_attention(df, ["k"], F.col("s"), F.col("v"), F.col("s")).collect()}
    assert got["a"].fused == pytest.approx(5) and 0 < got["a"].entropy < 1
    assert got["z"].fused == 2 and got["z"].entropy == 1 and got["one"].entropy == 0


def brute_dtw(a, b, band):
    d = {(0, 0): 0.0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(i - j) <= max(band, abs(len(a) - len(b))):
                d[i, j] = math.dist(a[i - 1], b[j - 1]) + min(d.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return d[len(a), len(b)]


def test_gesture_fixture(frame):
    wave = [[math.sin(i / 2), math.cos(i / 3)] for i in range(12)]
    push = [[i / 12, i / 6] for i in range(12)]
    query = [[x + 0.015, y - 0.01] for x, y in wave]
    df = frame([([v for p in query for v in p],), ([v for p in wave for v in p],), ([9.0] * 20,)], "x array<double>")
    df = df.withColumn("d", templates.template_distances("x", {"wave": wave, "push": push}, 2, band=3))
    out = df.select("d", templates.classify("d", ["wave", "push"], 5.0).alias("c")).collect()
    assert out[0].c.name == "wave" and out[0].c.confidence > 0.5 and out[1].c.distance == 0
    assert np.allclose(out[0].d, [brute_dtw(query, wave, 3), brute_dtw(query, push, 3)])
    assert out[2].c.name is None and out[2].d[1] == pytest.approx(brute_dtw([[9.0, 9.0]] * 10, push, 3))


def test_tdoa_recovers_positions():
    aps = np.array([(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)])
    true = np.array([[7.0, 11.0], [20.0, 5.0]])
    i, j = np.tile([0, 1, 2, 3, 0], (2, 1)), np.tile([1, 2, 3, 0, 2], (2, 1))
    d = np.linalg.norm(true[:, None] - aps[i], axis=2) - np.linalg.norm(true[:, None] - aps[j], axis=2)
    pos, residual = templates.tdoa_batch(i, j, d, aps)
    assert np.allclose(pos, true, atol=1e-5) and residual.max() < 1e-6


def test_cross_room_links_an_exit_once_and_keeps_all_in_the_gap():
    batch = lambda *rows: pd.DataFrame(rows, columns=["event_id", "us", "room", "is_exit", "v"])
    state, out = steps.cross_room(None, batch((1, 1_000_000, 1, True, [1.0, 0.1])))
    assert not len(out)
    state, out = steps.cross_room(state, batch((2, 6_000_000, 2, False, [1.0, 0.12]), (3, 7_000_000, 2, False, [1.0, 0.12])))
    assert out["candidates"].tolist() == [1, 0] and out["exit_id"].tolist()[0] == 1 and out["exit_id"].isna().tolist() == [False, True]
    state, _ = steps.cross_room(state, batch(*[(10 + k, 8_000_000 + k, 1, True, [1.0, 0.0]) for k in range(500)]))
    state, out = steps.cross_room(state, batch((600, 9_000_000, 2, False, [1.0, 0.0])))
    assert out["candidates"].tolist() == [500] and out["exit_id"].tolist() == [10] and len(state[0]) == 499
    state, out = steps.cross_room(state, batch((601, 200_000_000, 2, False, [1.0, 0.0])))
    assert out["candidates"].tolist() == [0] and state[0] == []


def scanner():
    """Feeds scans one after the other and returns each one's changes."""
    state = [None]

    def scan(n, points):
        state[0], out = steps.track(state[0], pd.DataFrame({"scan": [n], "dt": [1.0], "points": [points]}))
        return list(out.itertuples(index=False, name=None))

    return state, scan


def test_tracker_lifecycle():
    state, scan = scanner()
    assert [r[2] for r in scan(1, [[0, 0, 0], [50, 0, 0]])] == ["born", "born"]
    out = scan(2, [[0.1, 0, 0]])
    assert [(r[1], r[2], r[3]) for r in out] == [(1, "matched", "active"), (2, "terminated", "terminated")]
    for n in (3, 4):
        assert scan(n, []) == []
    assert [(r[1], r[3]) for r in scan(5, [])] == [(1, "lost")]
    changes = [scan(6 + k, []) for k in range(32)]
    assert [(r[1], r[3]) for c in changes for r in c] == [(1, "terminated")]
    assert state[0] == (2, b"")


def test_tracker_reidentifies_by_fingerprint():
    _, scan = scanner()
    who = {"b": 16.0, "a": 0.5, "h": 70.0, "l": [0.0, 0.0, 0.0]}
    scan(1, [{"pos": [0, 0, 0], "print": who}])
    scan(2, [{"pos": [0, 0, 0], "print": who}])
    for n in (3, 4, 5):
        scan(n, [])
    out = scan(6, [{"pos": [30, 0, 0], "print": who}])
    assert (out[0][1], out[0][2], out[0][3]) == (1, "reidentified", "active")


def test_tracker_takes_detections_without_a_place():
    _, scan = scanner()
    assert [r[2:] for r in scan(1, [None])] == [("born", "tentative", 0.0, 0.0)]
    assert [r[2] for r in scan(2, [{"pos": None, "print": None}, [0.0, 0.0, 0.0]])] == ["born", "matched"]


def test_tracks_do_not_depend_on_the_cut_into_batches():
    rng = np.random.default_rng(5)
    scans = pd.DataFrame({"scan": range(40), "dt": 1.0, "points": [rng.normal(0, 4, (rng.integers(0, 4), 3)).tolist() for _ in range(40)]})
    _, whole = steps.track(None, scans)
    state, parts = None, []
    for part in (scans[:7], scans[7:8], scans[8:]):
        state, out = steps.track(state, part.reset_index(drop=True))
        parts.append(out)
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole)


def test_every_open_exit_within_the_gap_is_seen(frame):
    # 500 exits are open; only the first of them looks like the entry.
    exits = [(1, k, 0, True, [1.0, 0.0] if k == 0 else [0.0, 1.0]) for k in range(500)]
    rows = exits + [(1, 500, 1, False, [1.0, 0.0]), (1, 2000, 1, False, [1.0, 0.0]), (2, 3, 1, False, [1.0, 0.0]), (1, 501, 0, False, [1.0, 0.0])]
    seq = S.sequence(frame(rows, "k int, t long, room int, x boolean, v array<double>").withColumn("i", F.col("t")), ["k"], ["t"])
    out = {(r["k"], r["i"]): r for r in matching.entry_candidates(seq, ["k"], F.col("x"), "room", "t", "i", "v", 600).collect()}
    assert (out[1, 500]["candidates"], out[1, 500]["exit_id"], out[1, 500]["similarity"]) == (500, 0, 1.0)
    assert [(out[k]["candidates"], out[k]["exit_id"]) for k in ((1, 2000), (2, 3), (1, 501))] == [(0, None)] * 3


def test_nearest_by_tiles_is_brute_force_and_meets_few_rows(frame):
    # Copies, an outlier and a crowded spot; a tile holds 16 rows, so all pairs of blocks would be 400 * 25.
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.uniform(0, 50, (300, 2)), np.full((60, 2), 7.0), np.repeat(rng.uniform(0, 50, (13, 2)), 3, axis=0), [[1e6, -1e6]]])
    df = frame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>")
    got = {}
    for r in nearest(df, df, "i", "i", "v", 3, "euclidean", skip_self=True, block=16).collect():
        got.setdefault(r.i, {})[r["rank"]] = r.near_i
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for i in range(len(v)):
        order = sorted((d[i, j], j) for j in range(len(v)) if j != i)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in order]
    met = near._by_distance(near._sized(df, "v"), near._sized(df, "v"), "i", "i", 3, True, 16)[0].count()
    assert met < 3 * 6 * len(v)


def test_copies_of_a_vector_tie_by_id(frame):
    rng = np.random.default_rng(6)
    v = np.tile(rng.normal(size=(7, 33)), (40, 1))
    df = frame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>")
    got = nearest(df, df, "i", "i", "v", 3, "cosine", skip_self=True, block=19).collect()
    for r in got:
        same = [j for j in range(r.i % 7, len(v), 7) if j != r.i]
        assert r.near_i == same[r["rank"] - 1]


def test_no_pair_of_entry_and_exit_leaves_a_task(frame):
    rng = random.Random(9)
    rows = [("s", t // 3, t, rng.random() < 0.5, rng.randrange(3), [math.cos(a), math.sin(a)]) for t in range(300) for a in [rng.uniform(0, 6)]]
    seq = S.sequence(frame(rows, "k string, t long, i long, x boolean, room int, v array<double>"), ["k"], ["t", "i"])
    for size in (7, 64, None):
        out = matching.entry_candidates(seq, ["k"], F.col("x"), "room", "t", "i", "v", 25, size=size)
        got = {r.i: (r.candidates, r.exit_id) for r in out.collect()}
        for _, t, i, is_exit, room, v in rows:
            if not is_exit:
                open_exits = [(-(w[0] * v[0] + w[1] * v[1]), j) for _, u, j, x, other, w in rows if x and j < i and t - u <= 25 and other != room]
                best = min(((round(n, 12), j) for n, j in open_exits), default=(0, None))
                assert got[i] == (len(open_exits), best[1] if -best[0] >= 0.8 else None)
    entry, exits = ([0, 1], [0, 0], [5, 6], [[1.0, 0.0]] * 2), ([-3, -2, -1], [7, 8, 9], [1, 1, 1], [1, 2, 3], [[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]])
    assert matching._best_exits(*entry, *exits, 3) == [(0, 2, -1.0, -2, 8), (1, 1, -1.0, -1, 9)]


def test_a_scan_of_a_few_detections_costs_a_few_array_operations():
    rng = np.random.default_rng(2)
    scans = pd.DataFrame({"scan": range(1000), "dt": 1.0, "points": [rng.normal(0, 9, (2, 3)).tolist() for _ in range(1000)]})
    x = np.ones(2)

    def best(run):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        return min(took)

    assert best(lambda: steps.track(None, scans)) < 120 * best(lambda: [x.sum() for _ in range(1000)])


def test_tracks_do_not_depend_on_how_costs_are_computed(monkeypatch):
    rng = np.random.default_rng(4)
    scans = pd.DataFrame({"scan": range(60), "dt": 1.0, "points": [[None if rng.random() < 0.1 else p.tolist() for p in rng.normal(0, 12, (rng.integers(0, 9), 3))] for _ in range(60)]})
    results = []
    for many in (1, 10**9):
        monkeypatch.setattr(steps, "MANY_PAIRS", many)
        results.append(steps.track(None, scans))
    assert results[0][0] == results[1][0]
    pd.testing.assert_frame_equal(results[0][1], results[1][1], check_exact=True)
