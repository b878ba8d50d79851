"""Exact top-k inner-product search with a pivot table.

One coordinate more makes all candidates equally long, sqrt(M^2 - |x|^2) with M the
greatest length; queries get 0 there. Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the
nearest candidates are those with the highest inner product, and the triangle inequality
holds. The distances d(x', p) to a few pivots are precomputed, and the greatest
|d(q', p) - d(x', p)| is a lower bound of the distance. Candidates are evaluated in the
order of their bounds until no bound allows the k-th score. A pivot's whole cell is left
out for a query when the cell's range of distances already rules it out.

Queries and candidates meet in blocks of bounded size; nothing depends on how far the
bounds reach, only the time does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.llm.base import finite, matrix, whole_units
from rippleframe.session import durable

K = 5
SCALE = 256.0
PIVOTS = 16
#: Pivots and the first k-th scores come from so many rows, the first by a hash of their id.
SAMPLE = 2048
CANDIDATE_BLOCK, QUERY_BLOCK, QUERY_CHUNK, STEP = 8192, 4096, 128, 256
LONGEST = 2.0**63


def quantise(rows: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, which hold these integers exactly."""
    return np.floor(rows * scale)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products of paired rows (n, m, width), as doubles where these are exact, else as Python integers."""
    most = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(queries.shape[-1], 1)
    if most < 2.0**53:
        return np.einsum("nd,nmd->nm", queries, candidates)
    exact = np.vectorize(int, otypes=[object])
    return (exact(queries)[:, None, :] * exact(candidates)).sum(-1)


def _augment(rows: np.ndarray, square: float) -> np.ndarray:
    rest = np.maximum(square - np.einsum("ij,ij->i", rows, rows), 0)
    return np.hstack([rows, np.sqrt(rest)[:, None]])


def choose_pivots(rows: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first rows."""
    if not len(rows):
        return rows
    picked, gap = [0], np.linalg.norm(rows - rows[0], axis=1)
    while len(picked) < min(count, len(rows)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(rows - rows[picked[-1]], axis=1))
    return rows[picked]


def pivot_distances(augmented: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(augmented - p, axis=1) for p in pivots], axis=1)


def _table(pivots: np.ndarray, square: float, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = quantise(matrix(batch.column(2), width))
            far = pivot_distances(_augment(x, square), pivots)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64())) for v in (x, far)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far.argmin(1).astype(np.int32)), *lists], names=["rid", "vec_id", "cell", "x", "far"])

    return run


def _allowed(far: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, square: float) -> np.ndarray:
    """The highest score that (queries, cells) can reach by the cells' distance ranges."""
    gap = np.maximum(np.maximum(low[None] - far[:, None, :], far[:, None, :] - high[None]), 0).max(-1)
    return (norm[:, None] + square - gap**2) / 2


def _send(cells: dict[int, tuple[int, list[float], list[float]]], pivots: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, square: float, width: int, k: int, query_blocks: int):
    """Queries to the blocks of every cell that may hold one of their k best."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sorted(cells), dtype=np.int64)
        low, high = (np.array([cells[c][n] for c in names.tolist()]) for n in (1, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, q = batch.column(0).to_numpy(), quantise(matrix(batch.column(2), width))
            norm = np.einsum("ij,ij->i", q, q)
            far = pivot_distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
            seen = (q @ sample.T).astype(np.float64)
            seen[rid[:, None] == sample_ids[None]] = -np.inf
            floor = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k] if seen.shape[1] >= k else np.full(len(q), -np.inf)
            reach = _allowed(far, norm, low, high, square)
            row, cell = np.nonzero(reach + 1e-9 * (norm[:, None] + square) + 1 >= floor[:, None])
            count = np.array([cells[c][0] for c in names[cell].tolist()], dtype=np.int64)
            row, cell, block = np.repeat(row, count), np.repeat(names[cell], count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v[row].ravel()), v.shape[1]).cast(pa.list_(pa.float64())) for v in (q, far)]
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array((rid[row] % query_blocks).astype(np.int32)), pa.array(np.ones(len(row), dtype=bool)), *lists],
                names=["rid", "vec_id", "cell", "block", "part", "query", "x", "far"],
            )

    return run


def best_in_block(q: np.ndarray, q_far: np.ndarray, q_rid: np.ndarray, x: np.ndarray, x_far: np.ndarray, x_rid: np.ndarray, x_id: np.ndarray, square: float, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query by score, then smaller id, in one pair of blocks."""
    norm = np.einsum("ij,ij->i", q, q)
    by_id = np.argsort(x_id, kind="stable")
    x, x_far, x_rid = x[by_id], x_far[by_id], x_rid[by_id]  # a lower index now is a smaller id
    for at in range(0, len(q), QUERY_CHUNK):
        rows = slice(at, at + QUERY_CHUNK)
        gap = np.zeros((len(q[rows]), len(x)))
        for p in range(q_far.shape[1]):
            np.maximum(gap, np.abs(q_far[rows, p, None] - x_far[None, :, p]), out=gap)
        most = (norm[rows, None] + square - gap**2) / 2
        most += 1e-9 * (norm[rows, None] + square) + 1  # rounding of the distances
        order = np.argsort(-most, axis=1, kind="stable")
        best = [[] for _ in range(len(gap))]
        active, done = np.arange(len(gap)), 0
        while len(active) and done < len(x):
            pick = order[active, done : done + STEP]
            value = scores(q[rows][active], x[pick])
            for n, a in enumerate(active.tolist()):
                s = value[n]
                if len(best[a]) >= k:
                    new = np.flatnonzero(s >= best[a][-1][0] * -1)
                else:
                    new = np.arange(len(s))
                fresh = [(-int(s[m]), int(pick[n, m])) for m in new.tolist() if x_rid[pick[n, m]] != q_rid[at + a]]
                best[a] = sorted(best[a] + fresh)[:k]
            done += STEP
            if done < len(x):
                bound = most[active, order[active, done]]
                active = np.array([a for a, b in zip(active.tolist(), bound.tolist()) if len(best[a]) < k or b >= -best[a][-1][0]], dtype=np.int64)
        for a, found in enumerate(best):
            for score, c in found:
                yield at + a, int(by_id[c]), -score


def _search(square: float, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, unit in whole_units(batches, ["cell", "block", "part"]):
            query, rid, ids = table.column("query").to_numpy(zero_copy_only=False).astype(bool), table.column("rid").to_numpy(), table.column("vec_id")
            x, far = matrix(table.column("x")), matrix(table.column("far"))
            order_id = ids.to_numpy(zero_copy_only=False).astype(np.float64) if ids.null_count else ids.to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for u in np.unique(unit):
                here = unit == u
                q, c = np.flatnonzero(here & query), np.flatnonzero(here & ~query)
                if len(q) and len(c):
                    for a, b, s in best_in_block(x[q], far[q], rid[q], x[c], far[c], rid[c], order_id[c], square, k):
                        out[0].append(q[a]), out[1].append(c[b]), out[2].append(s)
            a, b = (pa.array(np.array(o, dtype=np.int64)) for o in out[:2])
            limit = int(LONGEST)
            s = pa.array([min(max(v, -limit), limit - 1) for v in out[2]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rid[np.array(out[0], dtype=np.int64)]), ids.combine_chunks().take(a), ids.combine_chunks().take(b), s], names=["rid", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query, over (vec_id, embedding).

    Components become floor(256 * x); the score is the integer inner product, limited to
    the range of a long. Queries are the rows that meet ``is_query``, candidates all rows
    but the query's own; equal scores are ranked by smaller vec_id (null last). A query
    with fewer candidates gets them all. Vectors that are null or hold null or
    non-finite numbers take no part; shorter vectors are read as padded with zeros.
    Repeated rows are separate candidates and queries.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = durable(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "v"), "vectors")
    scaled = F.transform("v", lambda x: x.cast("double") * SCALE)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    norm = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("square"), F.count_if(F.expr(is_query)).alias("queries")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not stats["queries"]:
        return empty
    width, square = stats["width"], float(stats["square"])
    # A bounded sample: it fits the pivots and gives first k-th scores. Every row is indexed.
    first = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("rid", "v").toArrow()
    sample = quantise(matrix(first.column("v"), width))
    sample_ids = first.column("rid").to_numpy()
    pivots = choose_pivots(_augment(sample, square))
    table = durable(rows.mapInArrow(_table(pivots, square, width), "rid bigint, vec_id bigint, cell int, x array<double>, far array<double>"), "pivots")
    ends = [f(F.col("far")[p]).alias(f"{n}{p}") for p in range(len(pivots)) for f, n in ((F.min, "low"), (F.max, "high"))]
    ranges = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect()  # a row per pivot
    cells = {r["cell"]: (-(-r["n"] // CANDIDATE_BLOCK), [r[f"low{p}"] for p in range(len(pivots))], [r[f"high{p}"] for p in range(len(pivots))]) for r in ranges}
    parts = -(-stats["queries"] // QUERY_BLOCK)
    blocks = F.element_at(F.create_map(*[F.lit(v) for c, (n, *_) in cells.items() for v in (c, n)]), F.col("cell"))
    candidates = table.withColumn("block", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    candidates = candidates.select("rid", "vec_id", "cell", "block", "part", F.lit(False).alias("query"), "x", "far")
    send = _send(cells, pivots, sample, sample_ids, square, width, k, parts)
    asked = rows.where(F.expr(is_query)).mapInArrow(send, "rid bigint, vec_id bigint, cell int, block int, part int, query boolean, x array<double>, far array<double>")
    met = candidates.unionByName(asked).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part")
    found = met.mapInArrow(_search(square, k), "rid bigint, query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
