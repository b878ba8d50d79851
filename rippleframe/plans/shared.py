"""Skeleton tracks, state tables and grids that searchers share."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import shared_grids, state_table
from rippleframe.plans.registry import Tables, epoch_us, query, r6
from rippleframe.streaming import pose
from rippleframe.streaming.processors import apply_update, read_stream, run_available


@query()
def pose_tracks(spark, sf_dir):
    """Skeletons of each room, one or two per second, from the frames' first 51 values; weak joints coast."""
    em = read_stream(spark, sf_dir.rstrip("/"), "embeddings")
    joint = F.sequence(F.lit(0), F.lit(pose.JOINTS - 1))
    sure = F.transform(joint, lambda j: F.least(F.lit(1.0), 5 * F.abs(F.get("embedding", 63 - j))))
    places = F.transform(F.slice("embedding", 1, 3 * pose.JOINTS), lambda v: v.cast("double") * 2)
    rows = em.select("label", F.floor(F.col("vec_id") / 20).alias("at"), "vec_id", places.alias("places"), sure.alias("confidences"))
    schema = "label int, at long, track_id long, status string, hits long, misses long, x double, y double, z double, speed double, confidence double"
    out = run_available(apply_update(rows, ["label"], pose.pose_update, pose.POSE_STATE, ["at", "vec_id"], schema), "pose")
    return out.select("label", "at", "track_id", "status", "hits", "misses", *[r6(c).alias(c) for c in ("x", "y", "z", "speed", "confidence")])


CHANGES = """l AS (SELECT 'room_' || user_id % 11 || '.node_' || user_id AS entity, CASE WHEN event_type <> 'error' THEN event_type END AS state, value > 50 AS high, epoch_us(ts) AS us, event_id FROM events),
m AS (SELECT * FROM l WHERE us <= (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)),
p AS (SELECT *, lag(state) OVER w AS s0, lag(high) OVER w AS h0, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY entity ORDER BY us, event_id)),
c AS (SELECT *, CASE WHEN state IS NULL OR s0 IS NULL THEN NOT (state IS NULL AND s0 IS NULL) ELSE state <> s0 END AS changed FROM p),
t AS (SELECT entity, arg_max(coalesce(state, ''), i) AS state, arg_max(high, i) AS high, arg_max(us, i) AS last_updated, max(us) FILTER (changed AND state IS NOT NULL) AS last_changed,
  count(*) FILTER (changed OR (state IS NOT NULL AND s0 IS NOT NULL AND high IS DISTINCT FROM h0)) AS events FROM c GROUP BY entity)"""


def _states(spark, sf_dir):
    """States of all nodes half way through the log; an error removes its node."""
    ev = Tables(spark, sf_dir).events.withColumn("us", epoch_us("ts"))
    name = F.concat(F.lit("room_"), (F.col("user_id") % 11).cast("string"), F.lit(".node_"), F.col("user_id").cast("string"))
    log = ev.select(name.alias("entity"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("state"), (F.col("value") > 50).alias("high"), "us", "event_id")
    half = ev.agg(F.floor((F.min("us") + F.max("us")) / 2).alias("h")).scalar()
    return state_table.table(log, "entity", "state", ["high"], "us", ["us", "event_id"], half)


@query(f"WITH {CHANGES} SELECT entity, split_part(entity, '.', 1) AS domain, state, high, last_changed, last_updated, events FROM t WHERE state <> ''")
def state_table_as_of(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"WITH {CHANGES} SELECT entity, state, events FROM t WHERE state <> '' AND split_part(entity, '.', 1) = 'room_3'")
def states_of_domain(spark, sf_dir):
    return state_table.in_domain(_states(spark, sf_dir), "room_3").select("entity", "state", "events")


@query(
    """WITH c AS (SELECT user_id % 3 AS g, (user_id % 20)::INT AS x, (event_id % 15)::INT AS y, user_id, event_id, value / 97 AS p FROM events),
l AS (SELECT g, x, y, min(p) AS p FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g, x, y ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY g, x, y) AS n FROM c WHERE event_id % 4 > 0)
SELECT l.g, l.x, l.y, round(any_value(l.p) * pow(2.0, -coalesce(any_value(n), 0)) + coalesce(sum(r.p * pow(2.0, -k)), 0), 8) AS p, coalesce(any_value(n), 0)::BIGINT AS reports
FROM l LEFT JOIN r ON l.g = r.g AND l.x = r.x AND l.y = r.y GROUP BY l.g, l.x, l.y"""
)
def grid_gossip(spark, sf_dir):
    """Grids of three searchers after all reports of the others, in their order."""
    cells = Tables(spark, sf_dir).events.select((F.col("user_id") % 3).alias("g"), (F.col("user_id") % 20).cast("int").alias("x"), (F.col("event_id") % 15).cast("int").alias("y"), "event_id", (F.col("value") / 97).alias("p"))
    local = cells.groupBy("g", "x", "y").agg(F.min("p").alias("p"))
    out = shared_grids.merge(local, cells.where("event_id % 4 > 0"), ["g"], ["event_id"])
    return out.select("g", "x", "y", r6("p", 8).alias("p"), "reports")


@query(
    """WITH g AS (SELECT user_id % 40 AS g, (3 + user_id % 40 % 3)::INT AS w, 4 AS h FROM events GROUP BY ALL), s AS (SELECT DISTINCT user_id % 40 AS g, event_id % 6 AS x, event_id // 6 % 5 AS y FROM events WHERE event_type = 'view'),
c AS (SELECT g.g, x, y, CASE WHEN y % 2 = 0 THEN y * w + x ELSE y * w + w - 1 - x END AS no FROM g, (SELECT unnest(range(6)) AS x), (SELECT unnest(range(4)) AS y) WHERE x < w),
f AS (SELECT c.g, min(no) AS no FROM c LEFT JOIN s ON c.g = s.g AND c.x = s.x AND c.y = s.y WHERE s.g IS NULL GROUP BY c.g)
SELECT g.g, c.x::INT AS x, c.y::INT AS y FROM g LEFT JOIN f ON g.g = f.g LEFT JOIN c ON c.g = f.g AND c.no = f.no"""
)
def grid_next_cell(spark, sf_dir):
    """Where each of forty sweeps goes next."""
    ev = Tables(spark, sf_dir).events
    g = F.col("user_id") % 40
    grids = ev.select(g.alias("g")).distinct().select("g", (3 + F.col("g") % 3).cast("int").alias("width"), F.lit(4).alias("height"))
    seen = ev.where("event_type = 'view'").select(g.alias("g"), (F.col("event_id") % 6).cast("int").alias("x"), (F.floor(F.col("event_id") / 6) % 5).cast("int").alias("y"))
    return shared_grids.next_cell(seen, grids, ["g"])
