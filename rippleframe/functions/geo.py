"""Positions, zones, boxes and ranges as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippleframe.functions.vectors import col

SPEED_OF_LIGHT = 299_792_458.0
# Weight of a position by the kind of estimate.
SOURCE_WEIGHTS = {"range_constraint": 0.9, "depth_estimation": 0.6, "fused": 1.0}


def in_rectangle(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def in_circle(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return F.hypot(x - cx, y - cy) <= radius


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges crossed to the right of the point."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        right = x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        crossings = crossings + (spans & right).cast("int")
    return crossings % 2 == 1


def polygon_area(vertices: list[tuple[float, float]]) -> float:
    edges = zip(vertices, vertices[1:] + vertices[:1])
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in edges)) / 2


def rssi_to_distance(rssi: Column | str, reference: float = -30.0, d0: float = 1.0, exponent: float = 3.0) -> Column:
    return d0 * F.pow(F.lit(10.0), (reference - col(rssi)) / (10.0 * exponent))


def toa_to_distance(ns: Column | str, round_trip: bool = True) -> Column:
    metres = col(ns) * 1e-9 * SPEED_OF_LIGHT
    return metres / 2 if round_trip else metres


def distance_sigma(distance: Column, sigma: Column | None = None) -> Column:
    rule = F.greatest(F.lit(0.5), 0.1 * distance)
    return rule if sigma is None else F.coalesce(sigma, rule)


def distance3(a: Column, b: Column) -> Column:
    """Distance of (x, y, z) structs: three-dimensional only if both have z."""
    d2 = F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)
    return F.sqrt(d2 + F.coalesce(F.pow(a["z"] - b["z"], 2), F.lit(0.0)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of (x, y, w, h) structs."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point to a segment, all (x, y, z) structs."""
    axes = ("x", "y", "z")
    length = sum((b[k] - a[k]) * (b[k] - a[k]) for k in axes)
    t = sum((p[k] - a[k]) * (b[k] - a[k]) for k in axes) / length
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(F.lit(0.0))
    return F.sqrt(sum(F.pow(p[k] - (a[k] + t * (b[k] - a[k])), 2) for k in axes))


def combine_sigma(a: Column, b: Column) -> Column:
    """Inverse-variance combination of two standard errors."""
    return F.sqrt(1.0 / (1.0 / (a * a) + 1.0 / (b * b)))


def depth_from_attenuation(loss_db: Column, free_space_db: Column) -> Column:
    """Struct (depth, sigma, confidence); null beyond ten metres."""
    depth = (loss_db - free_space_db) / 3.0
    shallow = F.struct(F.lit(0.0).alias("depth"), F.lit(0.5).alias("sigma"), F.lit(0.9).alias("confidence"))
    deep = F.struct(
        depth.alias("depth"), (0.3 + 0.15 * depth).alias("sigma"),
        F.greatest(F.lit(0.3), 1.0 - depth / 10.0).alias("confidence"),
    )
    return F.when(loss_db < 3.0, shallow).when(depth <= 10.0, deep)


def bayes_cell(p: Column, confidence: Column, detected: Column) -> Column:
    like = F.when(detected, confidence).otherwise(1.0 - confidence)
    return like * p / (like * p + (1.0 - like) * (1.0 - p))


def fingerprint_distance(a: Column, b: Column) -> Column:
    """Weighted distance of (breathing, amplitude, heart, x, y, z) structs; heart may be null."""
    place = F.sqrt(sum(F.pow(a[k] - b[k], 2) for k in "xyz")) / 20.0
    base = 0.40 * F.abs(a["breathing"] - b["breathing"]) / 30.0 + 0.25 * F.abs(a["amplitude"] - b["amplitude"]) + 0.15 * place
    heart = 0.20 * F.abs(a["heart"] - b["heart"]) / 80.0
    return F.when(heart.isNull(), base / 0.80).otherwise((base + heart) / 1.0)


def gdop_from_angle(mean_angle: Column, sensors: Column) -> Column:
    factor = F.greatest(F.lit(1.0), F.abs(mean_angle / (math.pi / 2) - 1.0) + 1.0)
    return F.when((sensors < 2) | mean_angle.isNull(), F.lit(10.0)).otherwise(factor)
