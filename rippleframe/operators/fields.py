"""Empty-room field model and link tomography.

Only small per-model matrices ever meet in one task: features squared, or voxels
squared, both fixed by the configuration. The frames and links reach them as sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleframe.functions import geo
from rippleframe.functions import vectors as vec
from rippleframe.operators.sequence import attach

DOUBLES = T.ArrayType(T.DoubleType())


def outer_sums(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Sums of x and of x_i x_j over all frames as rows (i, j, total); j is -1 for x.

    Every task adds up its frames in NumPy and emits one matrix, so the shuffle
    carries tasks times width squared numbers, not frames times that.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, plain, n = np.zeros((width, width)), np.zeros(width), 0
        for batch in batches:
            col = batch.column(0)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(col), width)
            cross += x.T @ x
            plain += x.sum(axis=0)
            n += len(x)
        if n:
            flat = np.concatenate([[float(n)], plain, cross.ravel()]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["a"])

    cells = df.select(vector).mapInArrow(partial, "a array<double>").select(F.posexplode("a").alias("at", "v"))
    # Position 0 is the frame count, then the sums, then the products row by row.
    totals = cells.groupBy("at").agg(F.sum("v").alias("total"))
    k = F.col("at") - 1
    product = k - width
    i = F.when(k < width, k).otherwise(F.floor(product / width)).cast("int")
    j = F.when(k < width, F.lit(-1)).otherwise(product % width).cast("int")
    n = totals.filter("at = 0").select(F.col("total").cast("bigint")).scalar()
    return totals.filter("at > 0").select(i.alias("i"), j.alias("j"), "total", n.alias("n"))


def covariance(sums: DataFrame) -> DataFrame:
    """Sample covariance (i, j, value) and the means, from ``outer_sums``."""
    mean = sums.filter("j = -1").select("i", (F.col("total") / F.col("n")).alias("m"))
    cells = sums.filter("j >= 0")
    cells = attach(cells, mean.withColumnRenamed("m", "mi"), ["i"])
    cells = attach(cells, mean.select(F.col("i").alias("j"), F.col("m").alias("mj")), ["j"])
    value = (F.col("total") - F.col("n") * F.col("mi") * F.col("mj")) / F.greatest(F.col("n") - 1, F.lit(1))
    return cells.select("i", "j", "mi", "n", value.alias("value"))


def modes(cov: DataFrame, count: int) -> DataFrame:
    """Leading modes of a covariance table: mode, energy, share of variance, vector."""

    @F.pandas_udf(T.ArrayType(T.StructType([
        T.StructField("mode", T.IntegerType()), T.StructField("energy", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("vector", DOUBLES),
    ])))
    def solve(flat: pd.Series) -> pd.Series:
        out = []
        for values in flat:
            m = np.asarray(values)
            side = int(round(len(m) ** 0.5))
            m = m.reshape(side, side)
            w, v = np.linalg.eigh(m)
            order = np.argsort(-w)[:count]
            out.append([(int(k), float(w[o]), float(w[o] / np.trace(m)), v[:, o].tolist()) for k, o in enumerate(order)])
        return pd.Series(out)

    # One row of width squared values.
    cells = F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "value"))), lambda c: c["value"])
    matrix = cov.groupBy(F.lit(1).alias("_one")).agg(cells.alias("_m"))
    return matrix.select(F.explode(solve("_m")).alias("e")).select("e.*")


def perturbation(df: DataFrame, vector: str, cov: DataFrame, mode_table: DataFrame) -> DataFrame:
    """Frame energy left after subtracting the mean and projecting out the modes."""
    mean = cov.select("i", "mi").distinct().agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "mi"))), lambda c: c["mi"]).alias("m"))
    basis = mode_table.agg(F.transform(F.sort_array(F.collect_list(F.struct("mode", "vector"))), lambda c: c["vector"]).alias("b"))
    # Two scalar subqueries: one mean vector, one set of modes.
    rows = df.withColumn("_mean", mean.scalar()).withColumn("_basis", basis.scalar())

    def left_over(s):
        r = s["r"]
        along = F.transform(s["b"], lambda mode: vec.dot(r, mode))
        # Modes are orthonormal, so their shares add up as squares.
        return F.sqrt(F.greatest(vec.dot(r, r) - vec.dot(along, along), F.lit(0.0)))

    residual = F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)
    energy = vec.let(F.struct(residual.alias("r"), F.col("_basis").alias("b")), left_over)
    return rows.withColumn("energy", energy).drop("_mean", "_basis")


def link_weights(links: DataFrame, key: Sequence[str], nx: int, ny: int, bounds: tuple[float, float, float, float], wavelength: float = 0.125) -> DataFrame:
    """Voxels inside the Fresnel tube of each link (tx, rx structs), with weight 1 - d / r."""
    x0, y0, x1, y1 = bounds
    vx, vy = (x1 - x0) / nx, (y1 - y0) / ny
    rows = links.select("*", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("voxel"))
    at = F.struct((x0 + (F.col("voxel") % nx + 0.5) * vx).alias("x"), (y0 + (F.floor(F.col("voxel") / nx) + 0.5) * vy).alias("y"), F.lit(0.0).alias("z"))
    tx, rx = F.col("tx"), F.col("rx")
    length = F.greatest(F.sqrt(sum(F.pow(rx[k] - tx[k], 2) for k in "xyz")), F.lit(1e-12))
    radius = F.greatest(F.sqrt(wavelength * length / 4.0), F.lit(0.55 * min(vx, vy)))
    rows = rows.withColumn("_d", geo.segment_distance(at, tx, rx)).withColumn("_r", radius)
    return rows.filter(F.col("_d") < F.col("_r")).withColumn("weight", 1.0 - F.col("_d") / F.col("_r")).drop("_d", "_r")


def reconstruct(weights: DataFrame, key: Sequence[str], attenuation: str, n_voxels: int, ridge: float = 0.1) -> DataFrame:
    """Non-negative ridge solution per key as rows (key, voxel, density).

    ``weights`` has one row per (link, voxel). A' A and A' y are sums over links; the
    pairs are those of the voxels of one link, bounded by the grid.
    """
    per_link = weights.groupBy(*key, "link").agg(
        F.sort_array(F.collect_list(F.struct("voxel", "weight"))).alias("_w"), F.first(attenuation).alias("_y")
    )
    pair = per_link.select(*key, "_w", "_y", F.explode("_w").alias("a"))
    lhs = pair.select(*key, F.col("a.voxel").alias("i"), F.col("a.weight").alias("_wa"), F.explode("_w").alias("b")).groupBy(*key, "i", F.col("b.voxel").alias("j")).agg(
        F.sum(F.col("_wa") * F.col("b.weight")).alias("v")
    )
    rhs = pair.groupBy(*key, F.col("a.voxel").alias("i")).agg(F.sum(F.col("a.weight") * F.col("_y")).alias("v")).select(*key, "i", F.lit(-1).alias("j"), "v")
    system = lhs.unionByName(rhs).groupBy(*key).agg(F.collect_list(F.struct("i", "j", "v")).alias("_c"))

    @F.pandas_udf(DOUBLES)
    def solve(i: pd.Series, j: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(i, j, v):
            a, b, c = np.asarray(a), np.asarray(b), np.asarray(c)
            m, y = np.eye(n_voxels) * ridge, np.zeros(n_voxels)
            y[a[b < 0]] = c[b < 0]
            m[a[b >= 0], b[b >= 0]] += c[b >= 0]
            out.append(np.maximum(np.linalg.solve(m, y), 0.0))
        return pd.Series(out)

    dense = system.select(*key, solve("_c.i", "_c.j", "_c.v").alias("_x"))
    return dense.select(*key, F.posexplode("_x").alias("voxel", "density"))
