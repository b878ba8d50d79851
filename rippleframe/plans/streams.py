"""Stateful streaming queries over the event table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rippleframe.plans.registry import REGISTRY, epoch_us, query, r6
from rippleframe.streaming import steps
from rippleframe.streaming.processors import apply_update, read_stream, run_available


def _events(spark, sf_dir):
    ev = read_stream(spark, sf_dir.rstrip("/"), "events")
    return ev.select("user_id", "event_id", "event_type", "value", epoch_us("ts").alias("us"), (F.lit(0.8) + F.col("value") / 203).alias("amp"))


@query(REGISTRY["debounce_islands"].sql)
def stream_debounce(spark, sf_dir):
    """The debouncer as a stream; must agree with the batch query."""
    ev = _events(spark, sf_dir).select("user_id", "event_id", "us", (F.col("value") > 40).alias("hit"))
    out = apply_update(ev, ["user_id"], steps.debounce, steps.DEBOUNCE_STATE, ["us", "event_id"], "user_id long, event_id long, state boolean")
    return run_available(out, "debounce").select("event_id", "user_id", "state")


@query(
    """WITH e AS (SELECT *, 0.8 + value / 203 AS amp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
d AS (SELECT *, abs(amp - lag(amp) OVER (PARTITION BY user_id ORDER BY n)) AS s FROM e)
SELECT event_id, user_id, least(n, 16) AS frames, round(avg(amp) OVER w, 6) AS mean, round(var_pop(amp) OVER w, 6) AS variance,
  round(coalesce(avg(s) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 0), 6) AS delta FROM d
WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)"""
)
def stream_frame_window(spark, sf_dir):
    """Statistics over the last 16 frames of a node, updated per frame."""
    ev = _events(spark, sf_dir).select("user_id", "event_id", "us", "amp")
    schema = "user_id long, event_id long, frames long, mean double, variance double, delta double"
    out = run_available(apply_update(ev, ["user_id"], steps.frame_window, steps.WINDOW_STATE, ["us", "event_id"], schema), "frames")
    return out.select("event_id", "user_id", "frames", *[r6(c).alias(c) for c in ("mean", "variance", "delta")])


@query()
def cross_room_matches(spark, sf_dir):
    """One-to-one links from entries to open exits of the site."""
    ev = _events(spark, sf_dir).select(
        (F.col("user_id") % 8).alias("site"), "event_id", "us", (F.col("event_id") % 5).alias("room"),
        F.col("event_type").isin("view", "error").alias("is_exit"), F.array(F.cos("value"), F.sin("value")).alias("v"),
    )
    schema = "site long, event_id long, candidates long, exit_id long, similarity double"
    out = run_available(apply_update(ev, ["site"], hourly_links, steps.LINK_STATE, ["us", "event_id"], schema), "links")
    return out.select("site", "event_id", "candidates", "exit_id", r6("similarity").alias("similarity"))


def hourly_links(state, rows):
    return steps.cross_room(state, rows, max_gap_us=3_600_000_000)


def scan_events(state, rows):
    """One event is one scan: two detections around the node's position."""
    at, lane = rows["value"] / 50, (rows["event_id"] % 3).astype(float)
    points = [[] if kind == "error" else [[x, y, 0.0], [x + 20.0, 1.0, 0.0]] for kind, x, y in zip(rows["event_type"], at, lane)]
    return steps.track(state, pd.DataFrame({"scan": rows["event_id"], "dt": 1.0, "points": points}))


@query()
def survivor_tracks(spark, sf_dir):
    """Track lifecycle per node: births, matches, losses and terminations."""
    ev = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "us")
    schema = "user_id long, scan long, track_id long, change string, state string, x double, y double"
    out = run_available(apply_update(ev, ["user_id"], scan_events, steps.TRACK_STATE, ["us", "event_id"], schema), "tracks")
    return out.select("user_id", "scan", "track_id", "change", "state", r6("x").alias("x"), r6("y").alias("y"))


@query()
def coherence_tracker(spark, sf_dir):
    """Frames of each room against a reference that drifts with the accepted ones."""
    em = read_stream(spark, sf_dir.rstrip("/"), "embeddings")
    z = em.select("label", F.col("vec_id").alias("frame"), F.slice("embedding", 1, 32).alias("re"), F.slice("embedding", 33, 32).alias("im"))
    out = apply_update(z, ["label"], permissive_track, steps.COHERENCE_STATE, ["frame"], "label int, frame long, score double, stale long")
    return run_available(out, "coherence").select("label", "frame", r6("score").alias("score"), "stale")


def permissive_track(state, rows):
    return steps.coherence_track(state, rows, accept=0.4)
