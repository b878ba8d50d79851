"""Poses as arrays of 17 (x, y, confidence) structs, null where a joint is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippleframe.functions.vectors import col, let

# Joint order of the 17 keypoints, by group.
FACE = [0, 1, 2, 3, 4]
UPPER_BODY = [5, 6, 7, 8, 9, 10]
LOWER_BODY = [11, 12, 13, 14, 15, 16]
LEFT_HIP, RIGHT_SHOULDER = 11, 6


def visible(pose: Column | str, threshold: float = 0.5) -> Column:
    return F.filter(col(pose), lambda k: k.isNotNull() & (k["confidence"] >= threshold))


def bounding_box(pose: Column | str) -> Column:
    """(x, y, w, h) over visible joints; null when none is visible."""

    def box(v):
        xs, ys = F.transform(v, lambda k: k["x"]), F.transform(v, lambda k: k["y"])
        x, y = F.array_min(xs), F.array_min(ys)
        made = F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))
        return F.when(F.size(v) > 0, made)

    return let(visible(pose), box)


def torso(pose: Column | str) -> Column:
    """Left hip to right shoulder; 0 unless both are visible."""
    hip, shoulder = F.get(col(pose), F.lit(LEFT_HIP)), F.get(col(pose), F.lit(RIGHT_SHOULDER))
    seen = (hip["confidence"] >= 0.5) & (shoulder["confidence"] >= 0.5)
    return F.when(seen, F.hypot(hip["x"] - shoulder["x"], hip["y"] - shoulder["y"])).otherwise(F.lit(0.0))


def flat(pose: Column | str) -> Column:
    """51 numbers; missing joints are zeros."""
    zero = F.lit(0.0)
    return F.flatten(
        F.transform(col(pose), lambda k: F.array(F.coalesce(k["x"], zero), F.coalesce(k["y"], zero), F.coalesce(k["confidence"], zero)))
    )


def edges(pose: Column | str, pairs: list[tuple[int, int]], threshold: float = 0.5) -> Column:
    """Which skeleton edges have both ends visible."""
    ok = lambda i: F.coalesce(F.get(col(pose), F.lit(i))["confidence"] >= threshold, F.lit(False))
    return F.array(*[ok(a) & ok(b) for a, b in pairs])
