"""Connected components over links of long node ids, by alternating stars.

Each round rewires every node to the smallest node it knows: first its larger
neighbours (large star), then its smaller ones (small star). Only grouped minima and
equi-joins are used, so no component is ever collected; a hub is pre-aggregated and its
join side is split by Spark at run time. The number of rounds is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.session import durable


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; isolated nodes and roots have no row.

    Null ends and self-links are ignored. Runs jobs: each round is stored in the
    checkpoint folder, so a lost executor costs one round at most.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = durable(pairs.distinct(), "links")
    state = _state(edges)
    while state[0]:
        low = edges.groupBy(F.col("v").alias("x")).agg(F.min("v").alias("m"))
        low = low.union(edges.groupBy("u").agg(F.min("v"))).groupBy("x").agg(F.min("m").alias("m"))
        large = edges.join(low, edges["v"] == low["x"]).select("u", F.col("m").alias("v")).distinct()
        best = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(best, large["u"] == best["x"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.union(best.select("x", "m")).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
