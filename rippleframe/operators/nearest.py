"""Exact nearest neighbours without row pairs.

For cosines both sides are packed into blocks of at most ``block`` vectors. A query block meets
each corpus block through an equi-join on the block number, one matrix product
scores the pair, and only the best ``k`` per query leave the task. Memory per task
is two blocks; the shuffled volume is blocks times blocks, not rows times rows.
For distances the blocks are tiles of the plane: a query meets its own tile first, and then only
those that reach into the ball of its k-th distance, so the work grows with the rows.
Nothing is broadcast by hand: Spark broadcasts the corpus blocks only when their
measured size is below its threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleframe.session import durable

FAN_IN = 64
#: Rows of a tile, of a block of cosines, and of the products made at once.
BLOCK, COSINE_BLOCK, TILE = 1024, 8192, 1024
RESULT = T.ArrayType(
    T.StructType(
        [
            T.StructField("q", T.LongType()),
            T.StructField("c", T.LongType()),
            T.StructField("s", T.DoubleType()),
        ]
    )
)


def _sized(df: DataFrame, vector: str) -> DataFrame:
    kind = df.schema[vector].dataType.elementType.simpleString()
    return df.withColumn("_v", F.col(vector).cast("array<float>" if kind == "float" else "array<double>"))


def _packed(rows: DataFrame, ident: str, number: str, prefix: str) -> DataFrame:
    """Rows (prefix_no, prefix_ids, prefix_flat), ids ascending, of rows with a block ``number`` and a vector ``_v``."""
    packed = rows.groupBy(F.col(number).alias(f"{prefix}_no")).agg(F.sort_array(F.collect_list(F.struct(F.col(ident).alias("i"), F.col("_v").alias("v")))).alias("_p"))
    return packed.select(f"{prefix}_no", F.transform("_p", lambda p: p["i"]).alias(f"{prefix}_ids"), F.flatten(F.transform("_p", lambda p: p["v"])).alias(f"{prefix}_flat"))


def _rows(flat: np.ndarray, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def _best_cosine(qi: np.ndarray, a: np.ndarray, ci: np.ndarray, b: np.ndarray, k: int, skip_self: bool) -> list[tuple]:
    """Best ``k`` vectors of ``b`` for each of ``a``: screened by products in single precision, scored alike in double.

    A pair below the k-th best of its query by more than the error of the screen is never among the best. Scores are
    sums in one order, so copies of a vector tie and the lower id comes first.
    """
    out: list[tuple] = []
    known = np.isfinite(b).all(axis=1)
    ci, b = ci[known], b[known]
    la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    la, lb = np.where(la > 1e-12, la, np.inf), np.where(lb > 1e-12, lb, np.inf)  # a vector of almost no length scores 0
    b32 = (b / lb[:, None]).astype(np.float32)
    slack = 1e-6 + 4e-7 * a.shape[1] ** 0.5
    for at in range(0, len(qi), TILE):
        own, ids = a[at : at + TILE], qi[at : at + TILE]
        own32 = (own / la[at : at + TILE, None]).astype(np.float32)
        best_s, best_c = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for start in range(0, len(ci), TILE):
            s = own32 @ b32[start : start + TILE].T
            if skip_self:
                s[ids[:, None] == ci[None, start : start + TILE]] = -np.inf
            floor = best_s[:, -1]
            if not np.isfinite(floor).all() and s.shape[1] > k:
                floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            row, col = np.nonzero((s >= (floor - slack).astype(np.float32)[:, None]) & (s > -np.inf))
            for cut in range(0, len(row), TILE * TILE // 8):
                r, c = row[cut : cut + TILE * TILE // 8], col[cut : cut + TILE * TILE // 8] + start
                exact = np.einsum("ij,ij->i", own[r], b[c]) / (la[at + r] * lb[c])
                touched = np.unique(r)
                r = np.concatenate([r, np.repeat(touched, k)])
                exact, c = np.concatenate([exact, best_s[touched].ravel()]), np.concatenate([ci[c], best_c[touched].ravel()])
                order = np.lexsort((c, -exact, r))
                r, exact, c = r[order], exact[order], c[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                top = place < k
                best_s[r[top], place[top]], best_c[r[top], place[top]] = exact[top], c[top]
        row, place = np.nonzero(best_s > -np.inf)
        out += zip(ids[row].tolist(), best_c[row, place].tolist(), best_s[row, place].tolist())
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        square += (a[:, d, None] - b[None, :, d]) ** 2
    return np.sqrt(square)


def _best_distance(qi: np.ndarray, a: np.ndarray, ci: np.ndarray, b: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``ci``, distances) of the ``k`` nearest of each query, infinite where there are fewer."""
    near, far = np.zeros((len(qi), k), dtype=np.int64), np.full((len(qi), k), np.inf)
    for at in range(0, len(qi), 256):
        s = _distances(a[at : at + 256], b)
        if skip_self:
            s[qi[at : at + 256, None] == ci[None, :]] = np.inf
        s[np.isnan(s)] = np.inf
        if s.shape[1] > 4 * k:  # ids are ascending: all up to the k-th distance, then the first by distance and id
            limit = np.partition(s, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero((s <= limit[:, None]) & np.isfinite(s))
        else:
            row, col = np.nonzero(np.isfinite(s))
        order = np.lexsort((col, s[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, place = row[place < k], col[place < k], place[place < k]
        near[at + row, place], far[at + row, place] = col, s[row, col]
    return near, far


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    corpus_id: str,
    vector: str,
    k: int = 1,
    metric: str = "cosine",
    skip_self: bool = False,
    block: int | None = None,
) -> DataFrame:
    """Columns (query_id, corpus_id, score, rank) with the best ``k`` per query.

    ``metric`` is ``cosine`` or ``euclidean`` (score is then minus the distance).
    Ties go to the lower corpus id; ids are integers.
    """
    queries, corpus = _sized(queries, vector), _sized(corpus, vector)
    find = _by_cosine if metric == "cosine" else _by_distance
    rows, parts = find(queries, corpus, query_id, corpus_id, k, skip_self, block or (COSINE_BLOCK if metric == "cosine" else BLOCK))
    if parts > FAN_IN:
        # Merge in two rounds, so that no list holds an entry per corpus block.
        rows = _keep(rows.withColumn("_g", F.pmod(F.xxhash64("c"), F.lit(int(parts**0.5)))), ["q", "_g"], k)
    rows = _keep(rows, ["q"], k, ranks=True)
    near = corpus_id if corpus_id != query_id else f"near_{corpus_id}"
    return rows.select(F.col("q").alias(query_id), F.col("c").alias(near), F.col("s").alias("score"), "rank")


def _by_cosine(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, k: int, skip_self: bool, block: int) -> tuple[DataFrame, int]:
    """All pairs of blocks: the best ``k`` of each corpus block for each query, and the number of corpus blocks."""
    sizes = [max(1, -(-df.count() // block)) for df in (queries, corpus)]
    numbered = (df.withColumn("_no", F.pmod(F.xxhash64(i), F.lit(n))) for df, i, n in zip((queries, corpus), (query_id, corpus_id), sizes))
    (q, c), parts = (_packed(df, i, "_no", p) for df, i, p in zip(numbered, (query_id, corpus_id), "qc")), sizes[1]
    pairs = q.withColumn("c_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).join(c, "c_no")

    @F.pandas_udf(RESULT)
    def best(q_ids: pd.Series, q_flat: pd.Series, c_ids: pd.Series, c_flat: pd.Series) -> pd.Series:
        both = ((np.asarray(qi), _rows(qf, len(qi)), np.asarray(ci), _rows(cf, len(ci))) for qi, qf, ci, cf in zip(q_ids, q_flat, c_ids, c_flat))
        return pd.Series([_best_cosine(*pair, k, skip_self) for pair in both])

    return pairs.select(F.explode(best("q_ids", "q_flat", "c_ids", "c_flat")).alias("m")).select("m.*"), parts


def _tiles(corpus: DataFrame, block: int):
    """A function that adds ``_no``, the number of the tile of a row: strips of the first coordinate, cut by the last one.

    Cuts are approximate quantiles of the corpus, so that tiles hold about ``block`` rows; a tile of many equal
    points is dealt to several by id.
    """
    n = corpus.count()
    side = max(1, math.ceil(math.sqrt(n / block)))
    first, last = F.coalesce(F.get("_v", F.lit(0)).cast("double"), F.lit(0.0)), F.coalesce(F.element_at("_v", -1).cast("double"), F.lit(0.0))
    shares = [i / side for i in range(1, side)] or [0.5]
    cuts = lambda c: F.percentile_approx(c, shares, 10_000)
    strips = corpus.agg(cuts(first).alias("b")).first()["b"] or []
    strip = F.size(F.filter(F.array(*[F.lit(b) for b in strips]) if side > 1 and strips else F.array().cast("array<double>"), lambda b: b < first))
    inner = durable(corpus.groupBy(strip.alias("_strip")).agg(cuts(last).alias("_cuts")), "strips")

    def tiled(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_s", strip)
        rows = rows.join(F.broadcast(inner), rows["_s"] == inner["_strip"], "left")
        return rows.withColumn("_tile", F.col("_s") * (side + 1) + F.coalesce(F.size(F.filter("_cuts", lambda b: b < last)), F.lit(0))).drop("_s", "_strip", "_cuts")

    counts = tiled(corpus).groupBy(F.col("_tile").alias("_t")).agg(F.ceil(F.count(F.lit(1)) / (4 * block)).alias("_of"))
    counts = durable(counts, "tiles")

    def numbered(df: DataFrame, ident: str) -> DataFrame:
        rows = tiled(df)
        rows = rows.join(F.broadcast(counts), rows["_tile"] == counts["_t"], "left")
        part = F.pmod(F.xxhash64(ident), F.coalesce("_of", F.lit(1)))
        return rows.withColumn("_no", (F.col("_tile").cast("bigint") * F.lit(1 << 32) + part).cast("bigint")).drop("_tile", "_t", "_of")

    return numbered


def _by_distance(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, k: int, skip_self: bool, block: int) -> tuple[DataFrame, int]:
    """The best ``k`` of a query's own tile, then those of the tiles that reach into the ball of the ``k``-th distance."""
    numbered = _tiles(corpus, block)
    c = durable(_packed(numbered(corpus, corpus_id), corpus_id, "_no", "c"), "corpus")
    q = _packed(numbered(queries, query_id), query_id, "_no", "q")

    @F.pandas_udf("array<double>")
    def box(ids: pd.Series, flat: pd.Series) -> pd.Series:
        def of(i, f):
            v = np.asarray(f, dtype=np.float64).reshape(len(i), -1)
            return np.concatenate([np.fmin.reduce(v), np.fmax.reduce(v)])

        return pd.Series([of(i, f) for i, f in zip(ids, flat)])

    # One row per tile.
    found = c.select("c_no", box("c_ids", "c_flat").alias("b")).collect()
    tiles, boxes = np.array([r["c_no"] for r in found], dtype=np.int64), np.array([r["b"] for r in found])
    low, high = np.split(boxes, 2, axis=1) if len(boxes) else (np.empty((0, 1)),) * 2

    @F.pandas_udf("struct<m:array<struct<q:bigint,c:bigint,s:double>>,more:array<struct<no:bigint,i:bigint,v:array<double>>>>")
    def home(q_no: pd.Series, q_ids: pd.Series, q_flat: pd.Series, c_ids: pd.Series, c_flat: pd.Series) -> pd.DataFrame:
        pairs, more = [], []
        for no, qi, qf, ci, cf in zip(q_no, q_ids, q_flat, c_ids, c_flat):
            qi, a, reach = np.asarray(qi), np.asarray(qf, dtype=np.float64).reshape(len(qi), -1), np.full(len(qi), np.inf)
            pairs.append([])
            if ci is not None:
                ci = np.asarray(ci)
                near, far = _best_distance(qi, a, ci, np.asarray(cf, dtype=np.float64).reshape(len(ci), -1), k, skip_self)
                reach = far[:, -1]
                pairs[-1] = _pairs(qi, ci, near, far)
            gap = np.zeros((len(qi), len(tiles)))
            for d in range(a.shape[1]):
                gap += np.maximum(np.maximum(low[None, :, d] - a[:, d, None], a[:, d, None] - high[None, :, d]), 0.0) ** 2
            row, tile = np.nonzero((np.sqrt(gap) <= reach[:, None] * (1 + 1e-12)) & ((tiles != no) | (ci is None)))
            more.append([(int(tiles[t]), int(qi[r]), a[r].tolist()) for r, t in zip(row, tile)])
        return pd.DataFrame({"m": pairs, "more": more})

    @F.pandas_udf(RESULT)
    def best(q_ids: pd.Series, q_flat: pd.Series, c_ids: pd.Series, c_flat: pd.Series) -> pd.Series:
        out = []
        for qi, qf, ci, cf in zip(q_ids, q_flat, c_ids, c_flat):
            qi, ci = np.asarray(qi), np.asarray(ci)
            a, b = (np.asarray(f, dtype=np.float64).reshape(len(i), -1) for i, f in ((qi, qf), (ci, cf)))
            out.append(_pairs(qi, ci, *_best_distance(qi, a, ci, b, k, skip_self)))
        return pd.Series(out)

    own = q.join(c, q["q_no"] == c["c_no"], "left").select(home("q_no", "q_ids", "q_flat", "c_ids", "c_flat").alias("h"))
    own = durable(own.select("h.*"), "home")
    asked = own.select(F.explode("more").alias("e")).select(F.col("e.no").alias("_no"), F.col("e.i").alias("_i"), F.col("e.v").alias("_v"))
    # Queries that ask one tile go in blocks, so that a tile many ask is no task's burden.
    blocks = asked.withColumn("_part", F.pmod(F.xxhash64("_i"), F.lit(64)))
    blocks = blocks.groupBy("_no", "_part").agg(F.collect_list("_i").alias("q_ids"), F.flatten(F.collect_list("_v")).alias("q_flat"))
    rest = blocks.join(c, blocks["_no"] == c["c_no"]).select(F.explode(best("q_ids", "q_flat", "c_ids", "c_flat")).alias("m"))
    return own.select(F.explode("m").alias("m")).union(rest).select("m.*"), 1


def _pairs(qi: np.ndarray, ci: np.ndarray, near: np.ndarray, far: np.ndarray) -> list[tuple]:
    row, place = np.nonzero(np.isfinite(far))
    return list(zip(qi[row].tolist(), ci[near[row, place]].tolist(), (-far[row, place]).tolist()))


def _keep(rows: DataFrame, keys: list[str], k: int, ranks: bool = False) -> DataFrame:
    """Best ``k`` per key, lower corpus id first on ties."""
    entry = F.struct((-F.col("s")).alias("n"), "c")
    top = rows.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("_l"))
    out = top.select("q", F.posexplode("_l").alias("rank", "m"))
    out = out.select("q", F.col("m.c").alias("c"), (-F.col("m.n")).alias("s"), (F.col("rank") + 1).alias("rank"))
    return out if ranks else out.drop("rank")
