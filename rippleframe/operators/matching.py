"""Associations between events, rooms and labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.functions import vectors as vec
from rippleframe.operators.sequence import CHUNK, CORE, POS, WHOLE, attach, chunked, running

#: Consecutive rows of a block, and entries compared at once.
BLOCK, TILE = 8192, 256


def entry_candidates(
    seq: DataFrame,
    key: Sequence[str],
    is_exit: Column,
    room: str,
    at: str,
    ident: str,
    embedding: str,
    max_gap: int,
    pending: int | None = None,
    min_similarity: float = 0.8,
    size: int | None = None,
) -> DataFrame:
    """Best earlier exit from another room for every entry, among all exits within ``max_gap``.

    Rows are packed in blocks of ``size`` consecutive ones, and a block of entries meets the blocks of exits within two
    gaps. Only the best exit of a block and the number of candidates leave the task, never a
    pair. Similarity ties keep the earlier exit.

    With ``pending`` only that many last exits of a key are kept, as in a bounded exit list:
    rows carry the number of exits so far, and a range frame over that number collects the
    pending exits.
    """
    key = list(key)
    if pending is None:
        return _within_gap(seq, key, is_exit, room, at, ident, embedding, max_gap, min_similarity, size)
    rows = running(seq.withColumn("_x", is_exit), key, {"_seen": ("sum", F.col("_x").cast("bigint"))})
    rows = _with_open_exits(chunked(rows, size=size), key, pending)
    exit_row = F.when(
        F.col("_x"), F.struct(F.col("_seen").alias("n"), F.col(room).alias("room"), F.col(at).alias("at"),
                              F.col(ident).alias("id"), vec.l2_normalize(embedding).alias("v"))
    )
    recent = W.partitionBy(*key, CHUNK).orderBy("_seen").rangeBetween(1 - pending, 0)
    rows = rows.withColumn("_open", F.collect_list(exit_row).over(recent)).filter(F.col(CORE) & ~F.col("_x"))
    usable = F.filter(
        "_open",
        lambda e: (e["room"] != F.col(room)) & (F.greatest(F.col(at) - e["at"], F.lit(0)) <= max_gap),
    )
    best = lambda r: F.array_min(
        F.transform(
            r["open"], lambda e: F.struct((-vec.dot(e["v"], r["v"])).alias("neg"), e["n"].alias("n"), e["id"].alias("id"))
        )
    )
    rows = rows.withColumn("_r", F.struct(usable.alias("open"), vec.l2_normalize(embedding).alias("v")))
    rows = rows.select(*key, ident, F.size("_r.open").alias("candidates"), vec.let(F.col("_r"), best).alias("_best"))
    good = -F.col("_best.neg") >= min_similarity
    return rows.select(
        *key, ident, "candidates",
        F.when(good, F.col("_best.id")).alias("exit_id"),
        F.greatest(F.coalesce(-F.col("_best.neg"), F.lit(0.0)), F.lit(0.0)).alias("similarity"),
    )


def _vectors(rows: Sequence) -> np.ndarray:
    """Rows of one length, NaN where a vector is null or shorter."""
    width = max((len(v) for v in rows if v is not None), default=0)
    out = np.full((len(rows), width), np.nan)
    for k, v in enumerate(rows):
        if v is not None and len(v) == width:
            out[k] = np.asarray(v, dtype=np.float64)
    return out


def _best_exits(epos, eroom, eat, ev, xpos, xid, xroom, xat, xv, max_gap: int) -> list[tuple]:
    """(entry, candidates, minus similarity, exit's place, exit) for the entries of a block that exits of another can be linked to.

    Both are in event order, so what a few hundred entries may take is one range of exits.
    """
    epos, eat, xpos, xat = (np.asarray(v, dtype=np.int64) for v in (epos, eat, xpos, xat))
    codes, both = pd.factorize(np.concatenate([np.asarray(eroom, dtype=object), np.asarray(xroom, dtype=object)]))
    eroom, xroom = codes[: len(epos)], codes[len(epos) :]
    both = _vectors([*ev, *xv])
    ev, xv = both[: len(epos)], both[len(epos) :]
    out: list[tuple] = []
    for at in range(0, len(epos), TILE):
        own = slice(at, at + TILE)
        near = slice(int(np.searchsorted(xat, eat[at] - max_gap)), int(np.searchsorted(xpos, epos[own][-1])))
        if near.start >= near.stop:
            continue
        known = (eroom[own] >= 0)[:, None] & (xroom[near] >= 0)[None, :]
        may = known & (eroom[own][:, None] != xroom[near][None, :]) & (xpos[near][None, :] < epos[own][:, None]) & (eat[own][:, None] - xat[near][None, :] <= max_gap)
        like = np.zeros(may.shape)
        for d in range(both.shape[1]):
            like += ev[own, d, None] * xv[None, near, d]
        like[~may | np.isnan(like)] = -np.inf
        top = like.argmax(axis=1)  # the first of equals is the earlier exit
        count, likeness = may.sum(axis=1), like.max(axis=1)
        for k in np.flatnonzero(count):
            found = likeness[k] > -np.inf
            j = near.start + int(top[k])
            out.append((int(epos[at + k]), int(count[k]), float(-likeness[k]) if found else None, int(xpos[j]) if found else None, xid[j] if found else None))
    return out


def _within_gap(seq: DataFrame, key: list[str], is_exit: Column, room: str, at: str, ident: str, embedding: str, max_gap: int, min_similarity: float, size: int | None = None) -> DataFrame:
    rows = seq.select(*key, POS, F.col(ident).alias("_id"), F.col(room).alias("_room"), F.col(at).alias("_at"), is_exit.alias("_x"), vec.l2_normalize(embedding).alias("_v"))
    # Blocks of consecutive rows; an entry's block meets the exits' blocks that share one of its buckets of time.
    rows = rows.withColumn("_b", F.floor(F.col(POS) / (size or BLOCK)))
    entries, exits = rows.where(~F.col("_x")), rows.where("_x")
    bucket = F.floor(F.col("_at") / max(max_gap, 1))
    asked = entries.select(*key, F.col("_b").alias("_e"), F.explode(F.array(bucket - 1, bucket)).alias("_t")).distinct()
    there = exits.select(*key, "_b", bucket.alias("_t")).distinct()
    meet = attach(asked, there, [*key, "_t"], "inner", nulls=False).where("_b <= _e").select(*key, "_e", "_b").distinct()

    def packed(side: DataFrame, name: str, prefix: str) -> DataFrame:
        parts = side.groupBy(*key, F.col("_b").alias(name)).agg(F.sort_array(F.collect_list(F.struct(POS, "_id", "_room", "_at", "_v"))).alias("p"))
        return parts.select(*key, name, *[F.col(f"p.{c}").alias(f"{prefix}{c}") for c in (POS, "_id", "_room", "_at")], F.transform("p", lambda r: r["_v"].cast("array<double>")).alias(f"{prefix}_v"))

    pairs = attach(attach(meet, packed(entries, "_e", "e"), [*key, "_e"], "inner", nulls=False), packed(exits, "_b", "x"), [*key, "_b"], "inner", nulls=False)
    kind = rows.schema["_id"].dataType.simpleString()

    @F.pandas_udf(f"array<struct<at:bigint,c:bigint,neg:double,n:bigint,id:{kind}>>")
    def found(epos: pd.Series, eroom: pd.Series, eat: pd.Series, ev: pd.Series, xpos: pd.Series, xid: pd.Series, xroom: pd.Series, xat: pd.Series, xv: pd.Series) -> pd.Series:
        return pd.Series([_best_exits(*r, max_gap) for r in zip(epos, eroom, eat, ev, xpos, xid, xroom, xat, xv)])

    names = [f"e{POS}", "e_room", "e_at", "e_v", f"x{POS}", "x_id", "x_room", "x_at", "x_v"]
    met = pairs.select(*key, F.explode(found(*names)).alias("m")).select(*key, F.col("m.at").alias(POS), "m.c", "m.neg", "m.n", "m.id")
    # One row per entry and block of exits.
    best = met.groupBy(*key, POS).agg(F.sum("c").alias("_c"), F.min(F.when(F.col("neg").isNotNull(), F.struct("neg", "n", "id"))).alias("_best"))
    out = attach(entries.select(*key, POS, F.col("_id").alias(ident)), best, [*key, POS], nulls=False)
    sim = -F.col("_best.neg")
    return out.select(
        *key, ident, F.coalesce("_c", F.lit(0)).cast("int").alias("candidates"), F.when(sim >= min_similarity, F.col("_best.id")).alias("exit_id"),
        F.greatest(F.coalesce(sim, F.lit(0.0)), F.lit(0.0)).alias("similarity"),
    )


def _with_open_exits(rows: DataFrame, key: list[str], pending: int) -> DataFrame:
    """Add to every chunk the exits still open when it starts, flagged ``_core = false``.

    Chunks are cut by row, so a long stretch of entries is cut as well. The exits a
    chunk needs are addressed by their number, in blocks of ``pending``: two blocks
    at most, found with an equi-join.
    """
    if rows.schema[CHUNK].metadata.get(WHOLE, False):
        return rows
    starts = rows.groupBy(*key, F.col(CHUNK).alias("_to")).agg(F.min(F.col("_seen") - F.col("_x").cast("bigint")).alias("_before"))
    starts = starts.filter("_to > 0 AND _before > 0")
    block = lambda n: F.floor(n / pending)
    need = starts.withColumn("_block", F.explode(F.sequence(block(F.col("_before") - (pending - 1)), block(F.col("_before")))))
    exits = rows.filter("_x").withColumn("_block", block(F.col("_seen")))
    copies = attach(exits, need, [*key, "_block"], "inner", nulls=False)
    copies = copies.filter((F.col("_seen") <= F.col("_before")) & (F.col("_seen") > F.col("_before") - pending))
    copies = copies.withColumn(CHUNK, F.col("_to")).withColumn(CORE, F.lit(False)).select(rows.columns)
    return rows.unionByName(copies)


def triplets(df: DataFrame, ident: str, state: str, environment: str) -> DataFrame:
    """Lowest-id positive (same state, other environment) and negative (other state).

    The minimum id outside a row's own group is the first or second smallest group
    minimum, so two minima per state answer every row and no pairs are formed.
    """
    cell = df.groupBy(state, environment).agg(F.min(ident).alias("m"))
    low = lambda name: F.min(F.struct("m", F.col(name).alias("g")))
    # The smallest minimum of each state, then the smallest among the other environments: grouped minima, no lists.
    first = cell.groupBy(state).agg(low(environment).alias("_e1"))
    rest = attach(cell, first, [state]).filter(~F.col(environment).eqNullSafe(F.col("_e1.g")))
    second = rest.groupBy(state).agg(low(environment).alias("_e2"))
    envs = attach(first, second, [state]).withColumn("_envs", F.array_compact(F.array("_e1", "_e2"))).withColumn("m", F.col("_e1.m"))
    rows = attach(df, envs.select(state, "_envs"), [state])
    # Scalar subqueries: one entry each.
    best = envs.agg(low(state).alias("_s1")).scalar()
    other = envs.withColumn("_s1", best).filter(~F.col(state).eqNullSafe(F.col("_s1.g"))).agg(low(state).alias("_s2")).scalar()
    rows = rows.withColumn("_states", F.array_compact(F.array(best, other)))
    pick = lambda a, own: F.get(F.transform(F.filter(a, lambda p: p["g"] != F.col(own)), lambda p: p["m"]), 0)
    out = rows.select(
        F.col(ident).alias("anchor"),
        pick("_envs", environment).alias("positive"),
        pick("_states", state).alias("negative"),
    )
    return out.filter("positive IS NOT NULL AND negative IS NOT NULL")
