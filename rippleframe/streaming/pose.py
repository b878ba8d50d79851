"""Tracking of skeletons of 17 joints, written over arrays of all tracks of a key.

Every joint has its own constant-velocity filter with a diagonal state, so a detection may lack
joints: those below the confidence gate, or without a finite place, coast on their
velocity. A scan advances all tracks at once, pairs detections with tracks by the
distance of their centroids, nearest pair first, and starts a track for each detection left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

JOINTS = 17
TENTATIVE, ACTIVE, LOST, TERMINATED = range(4)
PHASES = ("tentative", "active", "lost", "terminated")
POSE_STATE = "born bigint, last double, tracks binary"
TRACK = np.dtype([
    ("id", "i8"), ("phase", "i8"), ("age", "i8"), ("hits", "i8"), ("misses", "i8"), ("place", "f8", (JOINTS, 3)), ("speed", "f8", (JOINTS, 3)),
    ("place_var", "f8", (JOINTS, 3)), ("speed_var", "f8", (JOINTS, 3)), ("sure", "f8", JOINTS),
])


@dataclass(frozen=True)
class PoseSettings:
    """Fixed values of the joint filter and of the life of a track."""

    default_dt: float = 1.0
    process_noise: float = 0.3
    measurement_noise: float = 0.08
    first_place_std: float = 0.10
    first_speed_std: float = 0.50
    speed_smoothing: float = 0.45
    confidence_smoothing: float = 0.55
    confidence_decay: float = 0.85
    min_confidence: float = 0.25
    max_distance: float = 1.25
    birth_hits: int = 2
    lost_after: int = 5
    dropped_after: int = 100


def _centroids(place: np.ndarray, sure: np.ndarray, use: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Confidence-weighted mean place of the joints in use; ``otherwise`` where there is none."""
    weight = np.where(use, np.maximum(sure, 1e-12), 0.0)
    total = weight.sum(1, keepdims=True)
    mean = (np.where(use[:, :, None], place, 0.0) * weight[:, :, None]).sum(1) / np.where(total > 0, total, 1.0)
    return np.where(use.any(1)[:, None], mean, otherwise)


def detections(places: list, confidences: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n, 17, 3) places and (n, 17) confidences in [0, 1] of detections given as flat lists; absent ones are NaN, absent confidences 1."""
    def row(values, width, fill):
        out = np.full(width, fill)
        given = np.array([np.nan if v is None else v for v in (() if values is None else values)], dtype=np.float64)[:width]
        out[: len(given)] = given
        return out

    place = np.array([row(p, JOINTS * 3, np.nan) for p in places]).reshape(-1, JOINTS, 3)
    sure = np.array([row(c, JOINTS, 1.0 if c is None else 0.0) for c in (confidences or [None] * len(places))]).reshape(-1, JOINTS)
    return place, np.clip(sure, 0.0, 1.0)


def advance(t: np.ndarray, dt: float, s: PoseSettings) -> None:
    """Predict all tracks ``dt`` seconds on; each counts as missed until it is observed."""
    q = s.process_noise**2
    t["place"] += t["speed"] * dt
    t["place_var"] += t["speed_var"] * dt**2 + q * dt**4 / 4
    t["speed_var"] += q * dt**2
    t["sure"] *= s.confidence_decay
    t["age"] += 1
    t["misses"] += 1


def pair(t: np.ndarray, place: np.ndarray, sure: np.ndarray, valid: np.ndarray, s: PoseSettings) -> np.ndarray:
    """The track of each detection, -1 for none: nearest centroids first, ties to the older track, then the earlier detection."""
    owner = np.full(len(place), -1)
    if not len(t) or not len(place):
        return owner
    at = _centroids(t["place"], t["sure"], t["sure"] >= s.min_confidence / 2, t["place"].mean(1))
    seen = _centroids(place, sure, valid, np.zeros((len(place), 3)))
    cost = np.sqrt(((at[:, None] - seen) ** 2).sum(2))
    cost[:, ~valid.any(1)] = np.inf
    taken = np.zeros(len(t), dtype=bool)
    for flat in np.argsort(cost, axis=None, kind="stable"):
        i, j = divmod(int(flat), len(place))
        if not cost[i, j] <= s.max_distance:
            break
        if not taken[i] and owner[j] < 0:
            owner[j], taken[i] = i, True
    return owner


def observe(t: np.ndarray, rows: np.ndarray, place: np.ndarray, sure: np.ndarray, valid: np.ndarray, dt: float, s: PoseSettings) -> None:
    """Correct the joints of tracks ``rows`` that their detections show."""
    own, use = t[rows], valid[:, :, None]
    noise = (s.measurement_noise / np.maximum(sure, 1e-3)) ** 2
    gain = own["place_var"] / (own["place_var"] + noise[:, :, None])
    ahead = np.where(use, place - own["place"], 0.0)
    trust = np.clip(s.speed_smoothing * gain.mean(2, keepdims=True), 0.0, 1.0)
    own["place"] += np.where(use, gain * ahead, 0.0)
    own["place_var"] = np.where(use, (1 - gain) * own["place_var"], own["place_var"])
    own["speed"] = np.where(use, (1 - trust) * own["speed"] + trust * ahead / dt, own["speed"])
    a = s.confidence_smoothing
    own["sure"] = np.where(valid, (1 - a) * own["sure"] + a * sure, own["sure"])
    own["misses"] = 0
    own["hits"] += 1
    own["phase"] = np.where(np.isin(own["phase"], (TENTATIVE, LOST)) & (own["hits"] >= s.birth_hits), ACTIVE, own["phase"])
    t[rows] = own


def born(first: int, place: np.ndarray, sure: np.ndarray, valid: np.ndarray, s: PoseSettings) -> np.ndarray:
    """New tracks; a joint that is not shown starts at the centroid without confidence."""
    t = np.zeros(len(place), dtype=TRACK)
    centre = _centroids(place, sure, valid, np.zeros((len(place), 3)))
    t["id"] = first + np.arange(len(place))
    t["place"] = np.where(valid[:, :, None], place, centre[:, None])
    t["sure"] = np.where(valid, sure, 0.0)
    t["place_var"], t["speed_var"] = s.first_place_std**2, s.first_speed_std**2
    t["age"], t["hits"], t["phase"] = 1, 1, ACTIVE if s.birth_hits <= 1 else TENTATIVE
    return t


def age(t: np.ndarray, missed: np.ndarray, s: PoseSettings) -> None:
    """Tracks that no detection was paired with are lost, then terminated."""
    misses = t["misses"][missed]
    t["phase"][missed] = np.where(misses >= s.dropped_after, TERMINATED, np.where(misses >= s.lost_after, LOST, t["phase"][missed]))


def scan(next_id: int, t: np.ndarray, dt: float, place: np.ndarray, sure: np.ndarray, s: PoseSettings = PoseSettings()) -> tuple[int, np.ndarray]:
    """One scan over the tracks that live; the result has those that end with it too."""
    dt = max(dt, 1e-9)
    t = t.copy()
    advance(t, dt, s)
    valid = np.isfinite(place).all(2) & np.isfinite(sure) & (sure >= s.min_confidence)
    owner = pair(t, place, sure, valid, s)
    held, new = np.flatnonzero(owner >= 0), np.flatnonzero(owner < 0)
    observe(t, owner[held], place[held], sure[held], valid[held], dt, s)
    missed = np.setdiff1d(np.arange(len(t)), owner[held])
    age(t, missed, s)
    return next_id + len(new), np.concatenate([t, born(next_id, place[new], sure[new], valid[new], s)])


def pose_update(state: tuple | None, rows: pd.DataFrame, settings: PoseSettings = PoseSettings()) -> tuple[tuple, pd.DataFrame]:
    """State update of a stream: ``rows`` has at (seconds; rows of one value are one scan), places and confidences (flat lists).

    A row with null places only marks a scan, so that a scan without detections is seen. The rows of
    a scan must arrive in one micro-batch. Time that stands still counts
    as the default step. Gives every living track of every scan, and those that end with it.
    """
    next_id, last, t = (state[0], state[1], np.frombuffer(bytes(state[2]), dtype=TRACK).copy()) if state else (0, None, np.empty(0, dtype=TRACK))
    out = []
    for at, group in rows.groupby("at", sort=True):
        seen = group[group["places"].notna()]
        place, sure = detections(list(seen["places"]), list(seen["confidences"]))
        dt = float(at) - last if last is not None and at > last else settings.default_dt
        next_id, t = scan(next_id, t, dt, place, sure, settings)
        last = float(at)
        centre = _centroids(t["place"], t["sure"], t["sure"] >= 0.1, t["place"].mean(1))
        out.append(pd.DataFrame({
            "at": at, "track_id": t["id"], "status": [PHASES[p] for p in t["phase"]], "hits": t["hits"], "misses": t["misses"],
            "x": centre[:, 0], "y": centre[:, 1], "z": centre[:, 2], "speed": np.sqrt((t["speed"].mean(1) ** 2).sum(1)), "confidence": t["sure"].mean(1),
        }))
        t = t[t["phase"] != TERMINATED]
    return (int(next_id), float(last), t.tobytes()), pd.concat(out, ignore_index=True)
