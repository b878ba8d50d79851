"""Probability grids that several searchers share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.operators import sequence as seqs


def merge(local: DataFrame, remote: DataFrame, grid: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``local`` (grid, x, y, p) after taking in all reports ``remote`` (grid, x, y, p and ``order``), and how many each cell took.

    A report moves a cell half way to its own value. Taken in by ``order`` (unique within a cell), the last of n reports
    weighs 1/2, the one before 1/4, and the cell's own value 2^-n, so the result is a weighted sum:
    the same whatever order the rows arrive in, and without a chain of updates. Cells that only
    remote grids have are not part of the local grid. Null values are no reports.
    """
    cell = [*grid, "x", "y"]
    known = remote.where(F.col("p").isNotNull()).select(*cell, *order, F.col("p").alias("q"))
    placed = seqs.sequence(known, cell, order)
    n = known.groupBy(*cell).agg(F.count(F.lit(1)).alias("reports"))
    weighed = seqs.attach(placed, n, cell, "inner")
    gathered = weighed.groupBy(*cell).agg(F.first("reports").alias("reports"), F.sum(F.col("q") * F.pow(F.lit(2.0), F.col(seqs.POS) - F.col("reports"))).alias("_sum"))
    out = seqs.attach(local.select(*cell, "p"), gathered, cell)
    reports = F.coalesce("reports", F.lit(0))
    return out.select(*cell, (F.col("p") * F.pow(F.lit(2.0), -reports) + F.coalesce("_sum", F.lit(0.0))).alias("p"), reports.alias("reports"))


def next_cell(scanned: DataFrame, grids: DataFrame, grid: Sequence[str]) -> DataFrame:
    """grid, x and y of the first cell not in ``scanned`` (grid, x, y), row by row, odd rows backwards; null if all are.

    ``grids`` has width and height of each grid. Cells outside are ignored. The way through a grid is numbered, so the
    answer is the first gap among the numbers of scanned cells, without a list of all cells.
    """
    grid = list(grid)
    inside = seqs.attach(scanned.select(*grid, "x", "y"), grids.select(*grid, "width", "height"), grid, "inner")
    inside = inside.where((F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height")))
    along = F.when(F.col("y") % 2 == 0, F.col("x")).otherwise(F.col("width") - 1 - F.col("x"))
    numbers = inside.select(*grid, (F.col("y").cast("bigint") * F.col("width") + along).alias("no")).distinct()
    ranked = seqs.sequence(numbers, grid, ["no"])
    gap = ranked.where(F.col("no") != F.col(seqs.POS)).groupBy(*grid).agg(F.min(seqs.POS).alias("_gap"))
    seen = numbers.groupBy(*grid).agg(F.count(F.lit(1)).alias("_seen"))
    out = seqs.attach(seqs.attach(grids.select(*grid, "width", "height"), seen, grid), gap, grid)
    first = F.coalesce("_gap", "_seen", F.lit(0))
    y = F.floor(first / F.col("width"))
    x = F.when(y % 2 == 0, first % F.col("width")).otherwise(F.col("width") - 1 - first % F.col("width"))
    free = first < F.col("width").cast("bigint") * F.col("height")
    return out.select(*grid, F.when(free, x).cast("int").alias("x"), F.when(free, y).cast("int").alias("y"))
