"""Range constraints: refinement of positions and assignment of ranges to tracks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.session import durable

# Gate in deviations, step, rounds and tolerance of the descent.
GATE, STEP, ROUNDS, TOLERANCE = 3.0, 1.0, 200, 1e-4
SIGMA_FLOOR, DISTANCE_FLOOR = 1e-6, 1e-9
AXES = ("x", "y", "z")


def deviation(position: Sequence[Column], anchor: Sequence[Column], measured: Column, sigma: Column) -> Column:
    """How many deviations a measured range is off at a position."""
    off = F.sqrt(sum(F.pow(p - a, 2) for p, a in zip(position, anchor))) - measured
    return F.abs(off) / F.greatest(sigma, F.lit(SIGMA_FLOOR))


def _descend(point: np.ndarray, owner: np.ndarray, anchor: np.ndarray, measured: np.ndarray, weight: np.ndarray, step: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and rounds used after weighted descent; constraints are sorted by ``owner`` (row of ``point``)."""
    point, used = point.copy(), np.zeros(len(point), dtype=np.int64)
    for _ in range(rounds):
        if not len(owner):
            break
        rows, first = np.unique(owner, return_index=True)
        delta = point[owner] - anchor
        distance = np.maximum(np.sqrt((delta**2).sum(1)), DISTANCE_FLOOR)
        pull = (2.0 * weight * (distance - measured) / distance)[:, None] * delta
        move = step / (2.0 * np.maximum(np.add.reduceat(weight, first), 1e-12))[:, None] * np.add.reduceat(pull, first)
        point[rows] -= move
        used[rows] += 1
        # Positions that stand still leave the batch.
        done = np.zeros(len(point), dtype=bool)
        done[rows] = np.sqrt((move**2).sum(1)) < tolerance
        left = ~done[owner]
        owner, anchor, measured, weight = owner[left], anchor[left], measured[left], weight[left]
    return point, used


def refine(
    positions: DataFrame, constraints: DataFrame, key: Sequence[str], gate: float = GATE, step: float = STEP, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """key, x, y, z, rounds, admitted, rejected (anchors) and rms of every position of ``positions`` (key, x, y, z).

    ``constraints`` has the key, anchor, ax, ay, az, measured and sigma. Those within ``gate`` deviations at the position
    given are admitted; the position then moves by weighted descent, the weights being inverse variances, until a
    move is shorter than ``tolerance``. ``rms`` is the deviation of the admitted ones at the end, null (no evidence)
    if there is none; the position then stays. Constraints with null or non-finite values or a
    sigma that is not positive are left out, as are those of unknown keys. The constraints of one
    position are gathered in a row: the anchors that one tag hears.
    """
    key = list(key)
    fields = ("ax", "ay", "az", "measured", "sigma")
    sound = F.lit(True)
    for c in fields:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    usable = constraints.where(sound & (F.col("sigma") > 0) & (F.col("measured") >= 0))
    marked = [F.col(k).alias(f"_{k}") for k in key]
    usable = usable.select(*marked, F.col("anchor").cast("string").alias("anchor"), *[F.col(c).cast("double").alias(c) for c in fields])
    same = F.lit(True)
    for k in key:
        same = same & (positions[k] == F.col(f"_{k}"))
    near = positions.select(*key, *[F.col(a).cast("double").alias(a) for a in AXES])
    met = near.join(usable, same, "left").drop(*[f"_{k}" for k in key])
    off = deviation([F.col(a) for a in AXES], [F.col(c) for c in ("ax", "ay", "az")], F.col("measured"), F.col("sigma"))
    met = met.withColumn("off", off)
    admitted = F.when(F.col("off") <= gate, F.struct("anchor", *fields))
    rejected = F.when(F.col("off") > gate, F.col("anchor"))
    held = met.groupBy(*key, *AXES).agg(F.sort_array(F.collect_list(admitted)).alias("c"), F.sort_array(F.collect_list(rejected)).alias("rejected"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point = np.stack([batch.column(a).to_numpy(zero_copy_only=False) for a in AXES], axis=1).reshape(-1, 3)
            lists = batch.column("c")
            size, flat = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()
            owner = np.repeat(np.arange(len(point)), size)
            ax, ay, az, measured, sigma = (flat.field(c).to_numpy(zero_copy_only=False) for c in fields)
            anchor = np.stack([ax, ay, az], axis=1).reshape(-1, 3)
            sigma = np.maximum(sigma, SIGMA_FLOOR)
            end, used = _descend(point, owner, anchor, measured, sigma**-2.0, step, rounds, tolerance)
            off = ((np.sqrt(((end[owner] - anchor) ** 2).sum(1)) - measured) / sigma) ** 2
            rms = np.sqrt(np.bincount(owner, off, len(point)) / np.maximum(size, 1))
            columns = [*[batch.column(k) for k in key], *end.T.copy(), used, size.astype(np.int64), batch.column("rejected"), pa.array(rms, mask=size == 0)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[*key, *AXES, "rounds", "admitted", "rejected", "rms"])

    kinds = {f.name: f.dataType.simpleString() for f in positions.schema.fields}
    schema = [f"{k} {kinds[k]}" for k in key] + [f"{a} double" for a in AXES] + ["rounds bigint", "admitted bigint", "rejected array<string>", "rms double"]
    return held.mapInArrow(run, ", ".join(schema))


def associate(constraints: DataFrame, tracks: DataFrame, on: Sequence[str], key: str, track: str, gate: float = GATE, cell: float = 8.0) -> DataFrame:
    """key, track and off (deviations): the best track within ``gate`` of every constraint; null if none is.

    Constraints have key, ax, ay, az, measured and sigma, tracks have track, x, y and z; both have ``on``. Of equal tracks
    the smallest id wins. A track further from the anchor than the range and its gate allow cannot be meant, so a
    constraint meets the tracks of the cells around its anchor only, not all of its group.
    """
    on = list(on)
    reach = F.col("measured") + gate * F.greatest(F.col("sigma"), F.lit(SIGMA_FLOOR))
    along = [F.sequence(F.floor((F.col(a) - reach) / cell), F.floor((F.col(a) + reach) / cell)) for a in ("ax", "ay")]
    asked = constraints.select(*on, key, "ax", "ay", "az", "measured", "sigma", F.explode(along[0]).alias("_cx"), along[1].alias("_all"))
    # Cells of a column that the circle of reach does not touch are left out.
    low, high = F.col("_cx") * cell, (F.col("_cx") + 1) * cell
    beside = F.greatest(low - F.col("ax"), F.col("ax") - high, F.lit(0.0))
    asked = asked.withColumn("_cy", F.explode("_all")).drop("_all")
    above = F.greatest(F.col("_cy") * cell - F.col("ay"), F.col("ay") - (F.col("_cy") + 1) * cell, F.lit(0.0))
    asked = asked.where(F.hypot(beside, above) <= reach)
    there = tracks.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(track).alias("_track"), *AXES, F.floor(F.col("x") / cell).alias("_tx"), F.floor(F.col("y") / cell).alias("_ty"))
    same = (F.col("_cx") == F.col("_tx")) & (F.col("_cy") == F.col("_ty"))
    for c in on:
        same = same & (asked[c] == there[f"_{c}"])
    off = deviation([F.col(a) for a in AXES], [F.col(c) for c in ("ax", "ay", "az")], F.col("measured"), F.col("sigma"))
    met = asked.join(there, same).select(F.col(key).alias("_key"), off.alias("_off"), F.col("_track").alias("_track")).where(F.col("_off") <= gate)
    # Minima of plain numbers are folded where the pairs arise; a minimum of pairs of numbers would have them all sorted first.
    least = durable(met.groupBy("_key").agg(F.min("_off").alias("_least")), "least")
    first = least.select(F.col("_key").alias("_k"), "_least")
    best = met.join(first, (F.col("_key") == F.col("_k")) & (F.col("_off") == F.col("_least"))).groupBy("_key").agg(F.min("_track").alias("_track"), F.min("_off").alias("_off"))
    return constraints.select(key).join(best, F.col(key) == F.col("_key"), "left").select(key, F.col("_track").alias(track), F.col("_off").alias("off"))
