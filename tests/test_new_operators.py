"""Packet updates, rolling rates, ranges, skeletons, state tables and shared grids against known answers and plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rippleframe.operators import ranging, rolling_spectra, shared_grids, state_table
from rippleframe.operators import sequence as S
from rippleframe.operators.frame_history import STATS, frame_history
from rippleframe.sources import packets, updates
from rippleframe.streaming import pose


def skeleton(x, sure=1.0):
    places = np.stack([x + np.linspace(0.0, 0.32, 17), np.linspace(0.0, 0.16, 17), np.full(17, 1.0)], axis=1)
    return places, np.full(17, sure)


def run_pose(settings, *scans):
    next_id, t = 0, np.empty(0, dtype=pose.TRACK)
    for dets in scans:
        place = np.array([d[0] for d in dets]).reshape(-1, 17, 3)
        sure = np.array([d[1] for d in dets]).reshape(-1, 17)
        next_id, t = pose.scan(next_id, t, 1.0, place, sure, settings)
        yield t
        t = t[t["phase"] != pose.TERMINATED]


def test_pose_is_smoothed_and_predicted_over_a_missed_scan():
    s = pose.PoseSettings(birth_hits=1, max_distance=3.0, min_confidence=0.4)
    first, second, third = run_pose(s, [skeleton(0.0)], [skeleton(1.0)], [])
    assert first["phase"][0] == pose.ACTIVE
    x = [t["place"][0, :, 0].mean() for t in (first, second, third)]
    assert x[0] < x[1] < skeleton(1.0)[0][:, 0].mean() and second["speed"][0, :, 0].mean() > 0
    assert third["misses"][0] == 1 and x[2] > x[1]


def test_weak_joints_do_not_move():
    place, sure = skeleton(0.1)
    place[0], sure[0] = 50.0, 0.05
    first, second = run_pose(pose.PoseSettings(birth_hits=1, max_distance=4.0), [skeleton(0.0)], [(place, sure)])
    assert second["place"][0, 0] == pytest.approx(first["place"][0, 0], abs=1e-6) and second["sure"][0, 0] < 1.0


def plain_pose(scans, s):
    """One track and joint at a time, from the definition of the filter."""
    tracks, next_id, out = [], 0, []
    for dets in scans:
        for t in tracks:
            for j in t["joints"]:
                j["p"] = j["p"] + j["v"]
                j["pv"] = j["pv"] + j["vv"] + s.process_noise**2 / 4
                j["vv"] = j["vv"] + s.process_noise**2
                j["c"] *= s.confidence_decay
            t["misses"] += 1
        usable = [[bool(np.isfinite(p).all() and c >= s.min_confidence) for p, c in zip(*d)] for d in dets]

        def centre(points, conf, use, empty):
            if not any(use):
                return empty
            return sum(max(c, 1e-12) * p for p, c, u in zip(points, conf, use) if u) / sum(max(c, 1e-12) for c, u in zip(conf, use) if u)

        costs = []
        for i, t in enumerate(tracks):
            points, conf = [j["p"] for j in t["joints"]], [j["c"] for j in t["joints"]]
            mine = centre(points, conf, [c >= s.min_confidence / 2 for c in conf], np.mean(points, axis=0))
            for k, (p, c) in enumerate(dets):
                if any(usable[k]) and (d := float(np.linalg.norm(mine - centre(p, c, usable[k], None)))) <= s.max_distance:
                    costs.append((d, i, k))
        tracks_used, dets_used = set(), set()
        for _, i, k in sorted(costs):
            if i in tracks_used or k in dets_used:
                continue
            tracks_used.add(i)
            dets_used.add(k)
            for j, p, c, u in zip(tracks[i]["joints"], *dets[k], usable[k]):
                if u:
                    gain = j["pv"] / (j["pv"] + (s.measurement_noise / max(c, 1e-3)) ** 2)
                    ahead = p - j["p"]
                    trust = s.speed_smoothing * gain.mean()
                    j["p"], j["pv"], j["v"] = j["p"] + gain * ahead, (1 - gain) * j["pv"], (1 - trust) * j["v"] + trust * ahead
                    j["c"] = (1 - s.confidence_smoothing) * j["c"] + s.confidence_smoothing * c
            tracks[i]["misses"], tracks[i]["hits"] = 0, tracks[i]["hits"] + 1
            if tracks[i]["phase"] != 1 and tracks[i]["hits"] >= s.birth_hits:
                tracks[i]["phase"] = 1
        for i, t in enumerate(tracks):
            if i not in tracks_used:
                t["phase"] = 3 if t["misses"] >= s.dropped_after else 2 if t["misses"] >= s.lost_after else t["phase"]
        for k, (p, c) in enumerate(dets):
            if k not in dets_used:
                fill = centre(p, c, usable[k], np.zeros(3))
                joints = [{"p": q.copy() if u else fill, "v": np.zeros(3), "pv": np.full(3, s.first_place_std**2), "vv": np.full(3, s.first_speed_std**2), "c": x if u else 0.0} for q, x, u in zip(p, c, usable[k])]
                tracks.append({"id": next_id, "phase": 0, "hits": 1, "misses": 0, "joints": joints})
                next_id += 1
        out.append([(t["id"], t["phase"], t["hits"], t["misses"], np.array([j["p"] for j in t["joints"]]), np.array([j["c"] for j in t["joints"]])) for t in tracks])
        tracks = [t for t in tracks if t["phase"] != 3]
    return out


def test_pose_equals_a_plain_loop_with_crossings_gaps_and_terminations():
    rng = np.random.default_rng(5)
    s = pose.PoseSettings(lost_after=2, dropped_after=4)
    scans = []
    for k in range(25):
        people = [skeleton(0.2 * k), skeleton(4.0 - 0.2 * k)][: rng.integers(0, 3)]
        dets = []
        for place, sure in people:
            place = place + rng.normal(0, 0.05, place.shape)
            sure = rng.uniform(0.0, 1.0, 17)
            place[rng.integers(0, 17)] = np.nan
            dets.append((place, sure))
        if k == 7:
            dets.append((np.full((17, 3), np.nan), np.ones(17)))
        scans.append(dets)
    for got, want in zip(run_pose(s, *scans), plain_pose(scans, s), strict=True):
        assert [(t["id"], t["phase"], t["hits"], t["misses"]) for t in got] == [w[:4] for w in want]
        for t, w in zip(got, want):
            assert t["place"] == pytest.approx(w[4]) and t["sure"] == pytest.approx(w[5])


def test_pose_state_crosses_batches_and_null_places_mark_a_scan():
    rows = [(1, skeleton(0.0)), (2, skeleton(0.1)), (3, None), (4, skeleton(0.3))]
    frame = pd.DataFrame([{"at": at, "places": None if d is None else d[0].ravel().tolist(), "confidences": None if d is None else d[1].tolist()} for at, d in rows])
    state, whole = pose.pose_update(None, frame)
    half, a = pose.pose_update(None, frame[:2])
    half, b = pose.pose_update(half, frame[2:])
    assert state == half and pd.concat([a, b], ignore_index=True).equals(whole)
    assert whole["misses"].tolist() == [0, 0, 1, 0] and whole["status"].tolist() == ["tentative", "active", "active", "active"]


def test_refine_moves_to_the_ranges_that_fit(frame):
    anchors = [("a", 0.0, 0.0, 0.0), ("b", 10.0, 0.0, 0.0), ("c", 0.0, 10.0, 0.0), ("d", 10.0, 10.0, 5.0)]
    true = (4.0, 3.0, 1.0)
    ranges = [(1, n, x, y, z, math.dist(true, (x, y, z)), 0.5) for n, x, y, z in anchors] + [(1, "bad", 5.0, 5.0, 0.0, 40.0, 0.5), (1, "null", None, 5.0, 0.0, 4.0, 0.5), (1, "flat", 1.0, 1.0, 1.0, 3.0, 0.0), (9, "x", 0.0, 0.0, 0.0, 1.0, 1.0)]
    constraints = frame(ranges, "tag long, anchor string, ax double, ay double, az double, measured double, sigma double")
    got = {r["tag"]: r for r in ranging.refine(frame([(1, 4.5, 3.5, 1.2), (2, 7.0, 8.0, 9.0)], "tag long, x double, y double, z double"), constraints, ["tag"]).collect()}
    assert math.dist((got[1]["x"], got[1]["y"]), true[:2]) < 0.02 and got[1]["rms"] < 0.05 and got[1]["admitted"] == 4 and got[1]["rejected"] == ["bad"]
    assert (got[2]["x"], got[2]["y"], got[2]["z"], got[2]["rms"], got[2]["rejected"]) == (7.0, 8.0, 9.0, None, []) and set(got) == {1, 2}
    assert ranging.refine(frame([], "tag long, x double, y double, z double"), constraints, ["tag"]).count() == 0


def test_associate_equals_all_pairs(frame):
    rng = np.random.default_rng(1)
    tracks = [(int(g), k, *rng.uniform(-30, 30, 2).tolist(), 1.0) for k, g in enumerate(rng.integers(0, 2, 60))]
    asked = [(int(g), k, *rng.uniform(-30, 30, 2).tolist(), 0.0, float(rng.uniform(0, 25)), float(rng.uniform(0.1, 0.4))) for k, g in enumerate(rng.integers(0, 3, 80))]
    out = ranging.associate(frame(asked, "g int, id int, ax double, ay double, az double, measured double, sigma double"), frame(tracks, "g int, track int, x double, y double, z double"), ["g"], "id", "track", cell=5.0)
    want = {}
    for g, k, ax, ay, az, m, s in asked:
        offs = sorted((abs(math.dist((x, y, z), (ax, ay, az)) - m) / s, t) for h, t, x, y, z in tracks if h == g)
        want[k] = offs[0][1] if offs and offs[0][0] <= 3 else None
    assert {r["id"]: r["track"] for r in out.collect()} == want and None in want.values()


def test_rolling_rate_finds_a_tone_from_the_first_usable_length(frame, monkeypatch):
    monkeypatch.setattr(rolling_spectra, "CHUNK_SAMPLES", 40)
    rows = [("a", k, math.sin(2 * math.pi * 0.25 * k / 2)) for k in range(150)] + [("flat", k, 1.0) for k in range(70)] + [("short", k, float(k)) for k in range(5)]
    seq = S.sequence(frame(rows, "node string, k long, v double"), ["node"], ["k"])
    out = rolling_spectra.rolling_rates(seq, ["node"], "v", 2.0, 0.1, 0.5, 60, 4, 20).toPandas().sort_values(["node", "pos"])
    a = out[out.node == "a"]
    assert a["pos"].tolist() == list(range(19, 150, 4)) and a["n"].tolist() == [min(60, p + 1) for p in range(19, 150, 4)]
    assert (a["status"] == "valid").all() and np.abs(a["bpm"] - 15.0).max() < 0.5 and np.abs(a["smoothed_bpm"] - 15.0).max() < 0.5
    flat = out[out.node == "flat"]
    assert (flat["status"] == "unavailable").all() and flat["bpm"].isna().all() and "short" not in set(out.node)


def test_welch_of_short_and_long_keys(frame, monkeypatch):
    monkeypatch.setattr(rolling_spectra, "CHUNK_SAMPLES", 16)
    rng = np.random.default_rng(2)
    x = {"long": rng.normal(size=53), "short": rng.normal(size=6), "one": rng.normal(size=1)}
    seq = S.sequence(frame([(n, k, float(v)) for n, s in x.items() for k, v in enumerate(s)], "node string, k long, v double"), ["node"], ["k"])
    out = rolling_spectra.welch(seq, ["node"], "v", 2.0, 16).toPandas()
    for node, values in x.items():
        n = min(16, len(values))
        taper = np.hanning(n) if n > 1 else np.ones(1)
        parts = [values[i : i + n] for i in range(0, len(values) - n + 1, 8 if n == 16 else n)]
        want = np.mean([np.abs(np.fft.rfft((p - p.mean()) * taper)) ** 2 / (2.0 * (taper**2).sum()) for p in parts], axis=0)
        got = out[out.node == node].sort_values("hz")
        assert got["psd"].to_numpy() == pytest.approx(want, abs=1e-12) and (got["segments"] == len(parts)).all()


def test_frame_history_across_chunks_and_changes_of_shape(frame, monkeypatch):
    from rippleframe.operators import frame_history as fh

    monkeypatch.setattr(fh, "CHUNK_FRAMES", 16)
    rng = np.random.default_rng(3)
    frames = [("n", k, rng.uniform(1, 2, 4 if 20 <= k < 25 else 6).tolist(), float(-k)) for k in range(45)] + [("empty", 0, [], -1.0)]
    rows = [(n, k, a, [0.1 * v for v in a], r, 2) for n, k, a, r in frames]
    seq = S.sequence(frame(rows, "node string, k long, amplitude array<double>, phase array<double>, rssi double, antennas int"), ["node"], ["k"])
    got = {(r["node"], r["k"]): r for r in frame_history(seq, ["node"], ["k"], 8).collect()}
    assert len(got) == 46 and got["empty", 0]["mean_amplitude"] is None and got["empty", 0]["cells"] == []
    for k in range(45):
        start = max(k - 7, 25 if k >= 25 else 20 if k >= 20 else 0)
        w = np.array([frames[i][2] for i in range(start, k + 1)])
        r = got["n", k]
        assert r["frame_count"] == len(w) and r["mean_amplitude"] == pytest.approx(w.mean()) and r["amplitude_variance"] == pytest.approx(w.var())
        d = np.diff(w, axis=0)
        assert r["temporal_delta"] == pytest.approx(np.abs(d).mean() if len(d) else 0.0) and r["mean_rssi"] == pytest.approx(-np.arange(start, k + 1).mean())
        assert r["subcarrier_variance"] == pytest.approx(w.var(axis=0, ddof=1).mean() if len(w) > 1 else 0.0)
        assert r["cells"] == pytest.approx(w.mean(0).reshape(2, -1).mean(0))
    assert set(STATS) <= set(got["n", 0].asDict())


def test_updates_keep_every_row_and_name_errors(frame):
    raw = frame([(1, bytes.fromhex("070000c5aa")), (2, b""), (3, None), (4, bytes.fromhex("040011c5" + "05" + "02" + "0000"))], "id long, packet binary")
    got = {r["id"]: r for r in updates.to_updates(packets.decode(raw), ["id"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["features"]["packet_type"] == "unknown" and got[1]["error"] == "unknown magic" and got[1]["nodes"] == [] and got[2]["error"] == "truncated magic"
    assert got[4]["features"]["packet_type"] == "wasm_event" and got[4]["features"]["events"] == [] and got[4]["nodes"][0]["node_id"] == "esp32-node-5"
    assert not any(r["classification"]["presence"] for r in got.values())


def test_state_table_folds_removals_no_ops_and_times(frame):
    log = [("light.a", "on", 1, 10), ("light.a", "on", 1, 20), ("light.a", "on", 2, 30), ("light.a", None, None, 40), ("light.a", None, None, 41), ("light.a", "off", 2, 50), ("Bad.Id", "on", 1, 5), (None, "on", 1, 5), ("fan.b", None, None, 5), ("fan.c", "on", 1, 60)]
    df = frame(log, "entity string, state string, level int, at long")
    fold = lambda as_of=None: {r["entity"]: r for r in state_table.table(df, "entity", "state", ["level"], "at", ["at"], as_of).collect()}
    now = fold()
    assert set(now) == {"light.a", "fan.c"} and (now["light.a"]["state"], now["light.a"]["last_changed"], now["light.a"]["events"]) == ("off", 50, 4)
    then = fold(F.lit(30))
    assert set(then) == {"light.a"} and (then["light.a"]["last_changed"], then["light.a"]["last_updated"], then["light.a"]["events"], then["light.a"]["level"]) == (10, 30, 2, 2)
    assert fold(F.lit(45)) == {} and fold(F.lit(1)) == {}


def test_grids_are_the_same_for_shuffled_reports(frame):
    local = frame([("g", 0, 0, 0.5), ("g", 1, 0, 0.25)], "g string, x int, y int, p double")
    reports = [("g", 0, 0, k, p) for k, p in enumerate([0.1, 0.9, 0.3])] + [("g", 7, 7, 9, 1.0), ("g", 1, 0, 0, None)]
    p = 0.5
    for q in (0.1, 0.9, 0.3):
        p = (p + q) / 2
    for rows in (reports, reports[::-1]):
        got = {(r["x"], r["y"]): (r["p"], r["reports"]) for r in shared_grids.merge(local, frame(rows, "g string, x int, y int, v long, p double"), ["g"], ["v"]).collect()}
        assert got == {(0, 0): (pytest.approx(p), 3), (1, 0): (0.25, 0)}


def test_next_cell_runs_back_and_forth(frame):
    grids = frame([("a", 3, 2), ("b", 3, 2), ("full", 1, 1), ("none", 0, 0)], "g string, width int, height int")
    seen = frame([("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 2, 1), ("a", 0, 1), ("a", 9, 9), ("full", 0, 0), ("full", 0, 0), ("other", 0, 0)], "g string, x int, y int")
    assert {r["g"]: (r["x"], r["y"]) for r in shared_grids.next_cell(seen, grids, ["g"]).collect()} == {"a": (1, 1), "b": (0, 0), "full": (None, None), "none": (None, None)}


def test_associated_pairs_are_not_sorted(frame, capsys):
    from rippleframe.operators import ranging

    asked = frame([(1, i, 0.0, 0.0, 0.0, 5.0, 0.5) for i in range(4)], "g int, id int, ax double, ay double, az double, measured double, sigma double")
    tracks = frame([(1, t, 3.0, 4.0, 0.0) for t in (9, 7, 8)] + [(1, 1, 30.0, 4.0, 0.0)], "g int, track int, x double, y double, z double")
    out = ranging.associate(asked, tracks, ["g"], "id", "track")
    assert sorted(tuple(r) for r in out.collect()) == [(i, 7, 0.0) for i in range(4)]
    out.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_rolling_rates_transform_each_window_once(frame):
    rows = [("a", k, math.sin(k)) for k in range(70)]
    out = rolling_spectra.rolling_rates(S.sequence(frame(rows, "node string, k long, v double"), ["node"], ["k"]), ["node"], "v", 2.0, 0.1, 0.5, 60, 4, 20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Rates are read twice, for themselves and for smoothing; both read what is stored.
    assert plan.count("InArrow") + plan.count("EvalPython") == 0, plan
    assert out.count() == 13
