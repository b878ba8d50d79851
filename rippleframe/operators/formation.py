"""Position-only flocking and formation targets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.operators.nearest import nearest

# Fixed values of the flocking rule.
SEPARATION_M, SEPARATION_WEIGHT, COHESION_WEIGHT, NEIGHBORS = 3.0, 1.5, 0.8, 7


def flock(points: DataFrame, ident: str, vector: str, k: int = NEIGHBORS) -> DataFrame:
    """Velocity change per node from its ``k`` nearest peers (``vector`` is [x, y])."""
    pairs = nearest(points, points, ident, ident, vector, k, "euclidean", skip_self=True)
    other = points.select(F.col(ident).alias(f"near_{ident}"), F.col(vector).alias("_o"))
    rows = pairs.join(other, f"near_{ident}").join(points.select(ident, F.col(vector).alias("_v")), ident)
    d = -F.col("score")
    push = F.when((d > 1e-6) & (d < SEPARATION_M), (SEPARATION_M - d) / SEPARATION_M / d).otherwise(F.lit(0.0))

    def axis(i):
        own, peer = F.get("_v", F.lit(i)), F.get("_o", F.lit(i))
        return SEPARATION_WEIGHT * F.sum((own - peer) * push) + COHESION_WEIGHT * F.avg(peer - own)

    return rows.groupBy(ident).agg(F.count(F.lit(1)).alias("peers"), axis(0).alias("vx"), axis(1).alias("vy"))


def grid_offset(index: Column, n: Column, spacing: float) -> Column:
    """Offset of a slot in a square grid of ``n`` slots."""
    side = F.ceil(F.sqrt(n.cast("double")))
    return F.struct((index % side * spacing).alias("x"), (F.floor(index / side) * spacing).alias("y"))


def circle_offset(index: Column, n: Column, radius: float) -> Column:
    angle = 2 * math.pi * index / n
    return F.struct((radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def toward(current: Column, target: Column, gain: float = 1.0, limit: float | None = None) -> Column:
    """Vector from ``current`` to ``target`` (x, y structs), no longer than ``limit``."""
    dx, dy = gain * (target["x"] - current["x"]), gain * (target["y"] - current["y"])
    size = F.hypot(dx, dy)
    scale = F.lit(1.0) if limit is None else F.when(size > limit, limit / size).otherwise(F.lit(1.0))
    return F.struct((dx * scale).alias("x"), (dy * scale).alias("y"))


def serpentine(step: Column, columns: int) -> Column:
    """Cell of a back-and-forth sweep at a step number."""
    y = F.floor(step / columns)
    x = step % columns
    return F.struct(F.when(y % 2 == 0, x).otherwise(columns - 1 - x).alias("x"), y.alias("y"))
