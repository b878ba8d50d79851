"""State updates of streams, written over arrays.

An update takes the typed state of a key (a tuple in the order of its ``*_STATE`` schema, or
None at first) and the rows of one micro-batch in event order. It returns the new state
and the output rows as a DataFrame. States hold a few numbers, the tail of a window, the
exits that can still be linked, or the live tracks.
"""

from __future__ import annotations

import math
import struct
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view

# Cross-room linking.
MIN_SIMILARITY = 0.8
MAX_GAP_US = 60_000_000

DEBOUNCE_STATE = "on bigint, off bigint, state boolean"
WINDOW_STATE = "tail array<double>"
BASELINE_STATE = "mean double, tail array<double>"
LINK_STATE = "id array<bigint>, room array<bigint>, us array<bigint>, vectors array<double>"
TRACK_STATE = "born bigint, tracks binary"
REGISTER_STATE = "places array<double>"
COHERENCE_STATE = "re array<double>, im array<double>, stale bigint"


def _numbers(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=np.float64, na_value=np.nan)


def _run_lengths(hit: np.ndarray, before: int) -> np.ndarray:
    """Length of the run of true values up to each place; ``before`` are in the run that reaches the first."""
    count = np.arange(1, len(hit) + 1)
    broken = np.maximum.accumulate(np.where(hit, 0, count))
    return np.where(hit, count - broken + np.where(broken == 0, before, 0), 0)


def debounce(state: tuple | None, rows: pd.DataFrame, confirm: int = 2, release: int = 2) -> tuple[tuple, pd.DataFrame]:
    """On after ``confirm`` hits in a row, off after ``release`` misses; null counts as a miss."""
    on, off, level = state or (0, 0, False)
    hit = np.equal(rows["hit"].to_numpy(dtype=object), True).astype(bool)
    on, off = _run_lengths(hit, on), _run_lengths(~hit, off)
    ups, downs = on >= confirm, off >= release
    last = np.maximum.accumulate(np.where(ups | downs, np.arange(len(hit)), -1))
    levels = np.where(last >= 0, ups[last], level)
    return (int(on[-1]), int(off[-1]), bool(levels[-1])), pd.DataFrame({"event_id": rows["event_id"], "state": levels})


def _windows(tail: list[float], x: np.ndarray, size: int) -> tuple[np.ndarray, list[float]]:
    """The last ``size`` samples at each place, NaN where there are fewer, and the tail to keep."""
    series = np.concatenate([np.full(size - 1, np.nan), tail, x])[-(len(x) + size - 1) :]
    return sliding_window_view(series, size), [float(v) for v in np.concatenate([tail, x])[-(size - 1) :]] if size > 1 else []


def _moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and population variance per row, without the NaNs."""
    here = ~np.isnan(w)
    n = here.sum(axis=1)
    mean = np.where(here, w, 0.0).sum(axis=1) / np.maximum(n, 1)
    return n, mean, np.where(here, (w - mean[:, None]) ** 2, 0.0).sum(axis=1) / np.maximum(n, 1)


def frame_window(state: tuple | None, rows: pd.DataFrame, size: int = 16) -> tuple[tuple, pd.DataFrame]:
    """Statistics over the last ``size`` samples of a node; missing samples count for nothing."""
    w, tail = _windows(list(state[0]) if state else [], _numbers(rows["amp"]), size)
    n, mean, variance = _moments(w)
    _, delta, _ = _moments(np.abs(np.diff(w, axis=1)))
    return (tail,), pd.DataFrame({"event_id": rows["event_id"], "frames": n, "mean": mean, "variance": variance, "delta": delta})


def rolling_baseline(state: tuple | None, rows: pd.DataFrame, alpha: float = 0.05, window: int = 64) -> tuple[tuple, pd.DataFrame]:
    """The first value replaces the baseline, later ones blend in; the threshold is mean plus deviation of raw values."""
    x = _numbers(rows["amp"])
    w, tail = _windows(list(state[1]) if state else [], x, window)
    _, mean, variance = _moments(w)
    start = [state[0]] if state else []
    blended = pd.Series(np.concatenate([start, x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(start) :]
    threshold = np.clip(mean + np.sqrt(variance), 0.0, 1.0)
    return (float(blended[-1]), tail), pd.DataFrame({"event_id": rows["event_id"], "mean": blended, "threshold": threshold})


def cross_room(state: tuple | None, rows: pd.DataFrame, max_gap_us: int = MAX_GAP_US, min_similarity: float = MIN_SIMILARITY) -> tuple[tuple, pd.DataFrame]:
    """Link each entry to the most similar open exit of another room within the gap, one to one.

    Exits stand in event order, so those an entry may take are a range found by search.
    Only the gap closes an exit; there is no limit to their number. Ties take the earlier.
    """
    ident, room, us = (rows[c].to_numpy(dtype=np.int64) for c in ("event_id", "room", "us"))
    v = np.stack([np.asarray(x, dtype=np.float64) for x in rows["v"]])
    length = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.where(length > 1e-12, v / np.maximum(length, 1e-300), 0.0)
    out = rows["is_exit"].to_numpy(dtype=bool)
    carried = [np.asarray(part, dtype=np.int64) for part in state[:3]] if state else [np.empty(0, dtype=np.int64)] * 3
    exit_id, exit_room, exit_us = (np.append(old, new[out]) for old, new in zip(carried, (ident, room, us)))
    vectors = np.concatenate([np.reshape(state[3] if state else [], (-1, v.shape[1])), v[out]])
    still_open = np.ones(len(exit_id), dtype=bool)
    since = np.searchsorted(exit_us, us - max_gap_us)
    until = len(carried[0]) + np.cumsum(out)
    links = []
    for k in np.flatnonzero(~out):
        near = slice(since[k], until[k])
        allowed = np.flatnonzero(still_open[near] & (exit_room[near] != room[k])) + since[k]
        likeness = vectors[allowed] @ v[k]
        best = max(float(likeness.max(initial=0.0)), 0.0)
        taken = allowed[int(likeness.argmax())] if best >= min_similarity else None
        if taken is not None:
            still_open[taken] = False
        links.append((ident[k], len(allowed), None if taken is None else int(exit_id[taken]), best))
    keep = np.flatnonzero(still_open & (exit_us >= us[-1] - max_gap_us))
    state = tuple(part[keep].tolist() for part in (exit_id, exit_room, exit_us)) + (vectors[keep].ravel().tolist(),)
    return state, pd.DataFrame(links, columns=["event_id", "candidates", "exit_id", "similarity"]).astype({"exit_id": "Int64"})


# Survivor tracking.
BIRTH_HITS, MAX_MISSES, MAX_LOST_S, REID, GATE = 2, 3, 30.0, 0.35, 9.0
OBS_VAR, PROCESS_VAR, FIRST_VAR, BLEND = 2.25, 0.01, 10.0, 0.3
PHASES = ("tentative", "active", "lost", "terminated")
TENTATIVE, ACTIVE, LOST, TERMINATED = range(4)
#: Weight and scale of a fingerprint's parts: breathing, amplitude, place, heart (which may be missing).
PRINT_WEIGHT, PRINT_SCALE = np.array([0.40, 0.25, 0.15, 0.20]), np.array([30.0, 1.0, 20.0, 80.0])

#: A stored track: number, place, speed, var, hits, misses, seconds lost, phase, fingerprint.
STORED = "=q3d3d3d2qdq6d"
#: Pairs of tracks and detections from which on their costs are computed as one array.
MANY_PAIRS = 256


@dataclass(slots=True)
class Track:
    """Scans hold a few tracks, so these are plain numbers: an array operation costs more than a whole scan.

    ``var`` is the variance of a coordinate, its covariance with the speed, and the variance of the
    speed. Motion and noise treat the three axes alike and apart, so these three numbers are the whole covariance.
    """

    id: int
    place: list[float]
    speed: list[float]
    var: list[float]
    hits: int
    misses: int
    lost: float
    phase: int
    mark: list[float]


def _live(stored: bytes) -> list[Track]:
    return [Track(v[0], [*v[1:4]], [*v[4:7]], [*v[7:10]], *v[10:14], [*v[14:]]) for v in struct.iter_unpack(STORED, stored)]


def _stored(tracks: list[Track]) -> bytes:
    return b"".join(struct.pack(STORED, t.id, *t.place, *t.speed, *t.var, t.hits, t.misses, t.lost, t.phase, *t.mark) for t in tracks)


def _number(x: float | None) -> float:
    return math.nan if x is None else float(x)


def _finite(x: float) -> float:
    """0 for NaN, the largest number for an infinite one."""
    return 0.0 if math.isnan(x) else max(-sys.float_info.max, min(x, sys.float_info.max))


def _mark(p: dict | None) -> list[float]:
    """A fingerprint as breathing, amplitude, x, y, z, heart; NaN where missing."""
    return [math.nan] * 6 if p is None else [_number(x) for x in (p["b"], p["a"], *p["l"], p.get("h"))]


def _mark_distance(marks: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Weighted distance over the parts both sides have; infinite where a side has no fingerprint."""
    gap = np.abs(marks - other)
    parts = np.stack([gap[:, 0], gap[:, 1], np.linalg.norm(gap[:, 2:5], axis=1), gap[:, 5]], axis=1) / PRINT_SCALE
    weight = PRINT_WEIGHT * ~np.isnan(parts)
    return np.where(np.isnan(gap[:, 0]), np.inf, np.nansum(parts * weight, axis=1) / np.maximum(weight.sum(axis=1), 1e-300))


def _advance(tracks: list[Track], dt: float) -> None:
    """Constant speed for ``dt`` seconds under white acceleration."""
    noise = PROCESS_VAR * (dt**4 / 4), PROCESS_VAR * (dt**3 / 2), PROCESS_VAR * dt**2
    for t in tracks:
        t.place = [x + dt * v for x, v in zip(t.place, t.speed)]
        var, cov, speed = t.var
        t.var = [var + dt * (2 * cov + dt * speed) + noise[0], cov + dt * speed + noise[1], speed + noise[2]]


def _observe(t: Track, seen: list[float], mark: list[float]) -> None:
    """Correct a track by the place ``seen`` and blend ``mark`` in; NaN leaves a value as it is."""
    var, cov, speed = t.var
    known = not any(map(math.isnan, seen))
    share = 1 / (var + OBS_VAR) if known else 0.0  # without a place nothing is learned
    miss = [a - b for a, b in zip(seen, t.place)] if known else [0.0] * 3
    t.place = [x + share * var * m for x, m in zip(t.place, miss)]
    t.speed = [v + share * cov * m for v, m in zip(t.speed, miss)]
    t.var = [var - share * (var * var), cov - share * (var * cov), speed - share * (cov * cov)]
    old = [m if math.isnan(o) else o for o, m in zip(t.mark, mark)]
    t.mark = [o if math.isnan(m) else o + BLEND * (m - o) for o, m in zip(old, mark)]
    t.hits += 1
    t.misses, t.lost = 0, 0.0
    if t.hits >= BIRTH_HITS:
        t.phase = ACTIVE


def _miss(t: Track, dt: float) -> None:
    """Age an unseen track: a tentative one ends, an active one gets lost, a lost one ends in time."""
    if t.phase == ACTIVE:
        t.misses += 1
        if t.misses >= MAX_MISSES:
            t.phase = LOST
    elif t.phase == LOST:
        t.lost += max(dt, 0.0)
        if t.lost > MAX_LOST_S:
            t.phase = TERMINATED
    elif t.phase == TENTATIVE:
        t.phase = TERMINATED


def _gated(tracks: list[Track], seen: list[list[float]]) -> list[tuple[float, int, int]]:
    """(cost, track, detection) of the pairs within the gate, nearest first; an unknown place gates nothing."""
    if len(tracks) * len(seen) < MANY_PAIRS:
        pairs = []
        for i, t in enumerate(tracks):
            if t.phase <= ACTIVE:
                (x, y, z), spread = t.place, t.var[0] + OBS_VAR
                for j, (a, b, c) in enumerate(seen):
                    cost = ((a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z)) / spread
                    if cost <= GATE:
                        pairs.append((cost, i, j))
        return sorted(pairs)
    place, spread, sight = np.array([t.place for t in tracks]), np.array([[t.var[0]] for t in tracks]) + OBS_VAR, np.array([[t.phase <= ACTIVE] for t in tracks])
    gap = np.array(seen)[None] - place[:, None]
    square = gap * gap
    cost = (square[:, :, 0] + square[:, :, 1] + square[:, :, 2]) / spread
    i, j = np.nonzero(sight & (cost <= GATE))
    return sorted(zip(cost[i, j].tolist(), i.tolist(), j.tolist()))


def _owners(tracks: list[Track], seen: list[list[float]], marks: list[list[float]]) -> tuple[list[int], set[int]]:
    """Track of each detection, or -1, and the detections whose track was found by fingerprint.

    Tracks in sight take the nearest gated pairs first; lost ones are then found by their fingerprint.
    """
    owner, taken = [-1] * len(seen), set()
    for _, i, j in _gated(tracks, seen):
        if owner[j] < 0 and i not in taken:
            owner[j] = i
            taken.add(i)
    by_mark: set[int] = set()
    free = [t.phase == LOST for t in tracks]
    for j, mark in enumerate(marks):
        if owner[j] < 0 and not math.isnan(mark[0]) and any(free):
            distance = np.where(free, _mark_distance(np.array([t.mark for t in tracks]), np.array(mark)), np.inf)
            i = int(distance.argmin())
            if distance[i] < REID:
                owner[j], free[i] = i, False
                by_mark.add(j)
    return owner, by_mark


def track_scan(born: int, tracks: list[Track], dt: float, points: list) -> tuple[int, list[Track], list[tuple]]:
    """One scan: advance, assign, re-identify, give birth, age, drop.

    ``points`` holds [x, y, z] or dicts with ``pos`` and ``print`` (a fingerprint), either of
    which may be None; a detection without a place that no track owns starts one at the
    origin. Returns (track_id, change, state, x, y) rows: detections first, then aged tracks.
    """
    points = [p if isinstance(p, dict) else {"pos": p, "print": None} for p in points]
    seen = [[math.nan] * 3 if p["pos"] is None else [_number(x) for x in p["pos"]] for p in points]
    marks = [_mark(p.get("print")) for p in points]
    _advance(tracks, dt)
    owner, by_mark = _owners(tracks, seen, marks)
    unseen, change = set(range(len(tracks))).difference(owner), []
    tracks = list(tracks)
    for j, i in enumerate(owner):
        if i >= 0:
            _observe(tracks[i], seen[j], marks[j])
            change.append("reidentified" if j in by_mark else "matched")
        else:
            born, owner[j] = born + 1, len(tracks)
            tracks.append(Track(born, [_finite(x) for x in seen[j]], [0.0] * 3, [FIRST_VAR, 0.0, FIRST_VAR], 1, 0, 0.0, ACTIVE if BIRTH_HITS <= 1 else TENTATIVE, marks[j]))
            change.append("born")
    for i in sorted(unseen):
        before = tracks[i].phase
        _miss(tracks[i], dt)
        if tracks[i].phase != before:
            owner.append(i)
            change.append(PHASES[tracks[i].phase])
    out = [(t.id, how, PHASES[t.phase], t.place[0], t.place[1]) for t, how in zip((tracks[i] for i in owner), change)]
    return born, [t for t in tracks if t.phase != TERMINATED], out


def track(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Tracks over scans: ``rows`` has ``scan``, ``dt`` and ``points`` (see ``track_scan``)."""
    born, tracks = (int(state[0]), _live(bytes(state[1]))) if state else (0, [])
    out = []
    for scan, dt, points in zip(rows["scan"], rows["dt"], rows["points"]):
        born, tracks, changes = track_scan(born, tracks, float(dt), list(points))
        out += [(scan, *c) for c in changes]
    return (born, _stored(tracks)), pd.DataFrame(out, columns=["scan", "track_id", "change", "state", "x", "y"])


def upsert_survivor(state: tuple | None, rows: pd.DataFrame, radius: float = 2.0) -> tuple[tuple, pd.DataFrame]:
    """Attach a detection to the first recorded survivor closer than ``radius``, or record a new one.

    Detections without a place always start a new record. The register is the result, so
    the state holds one place per survivor; key it by zone.
    """
    known = [np.reshape(state[0] if state else [], (-1, 3))]
    out = []
    for ident, place in zip(rows["event_id"], rows["place"]):
        at = np.full(3, np.nan) if place is None else np.asarray(place, dtype=np.float64)
        known = [np.concatenate(known)]
        close = np.flatnonzero(((known[0] - at) ** 2).sum(axis=1) < radius * radius)
        if not len(close):
            known.append(at[None])
        out.append((ident, int(close[0]) + 1 if len(close) else len(known[0]) + 1, not len(close)))
    return (np.concatenate(known).ravel().tolist(),), pd.DataFrame(out, columns=["event_id", "survivor", "is_new"])


def coherence_track(state: tuple | None, rows: pd.DataFrame, accept: float = 0.85, decay: float = 0.95) -> tuple[tuple, pd.DataFrame]:
    """Score complex frames against a reference that only accepted frames update; the first frame is the reference."""
    z = np.stack([np.asarray(v, dtype=np.float64) for v in rows["re"]]) + 1j * np.stack([np.asarray(v, dtype=np.float64) for v in rows["im"]])
    size, norm = np.abs(z), np.linalg.norm(z, axis=1)
    ref, stale = (np.asarray(state[0]) + 1j * np.asarray(state[1]), state[2]) if state else (None, 0)
    scores, waits = np.ones(len(z)), np.zeros(len(z), dtype=np.int64)
    for k in range(len(z)):
        if ref is None:
            ref = z[k]
            continue
        own = np.abs(ref)
        length = np.linalg.norm(ref)
        if min(norm[k], length) <= 1e-12:
            corr = stable = float(max(norm[k], length) <= 1e-12)
        else:
            inner, weight = abs(np.vdot(ref, z[k])), size[k] @ own
            corr = min(inner / (norm[k] * length), 1.0)
            stable = min(inner / weight, 1.0) if weight > 1e-12 else 0.0
        both = norm[k] + length
        level = max(0.0, 1.0 - np.linalg.norm(size[k] - own) / both) if both > 1e-12 else 1.0
        scores[k] = 0.45 * corr + 0.35 * level + 0.20 * stable
        taken = scores[k] >= accept
        stale = 0 if taken else stale + 1
        ref = decay * ref + (1 - decay) * z[k] if taken else ref
        waits[k] = stale
    return (ref.real.tolist(), ref.imag.tolist(), int(stale)), pd.DataFrame({"frame": rows["frame"], "score": scores, "stale": waits})
