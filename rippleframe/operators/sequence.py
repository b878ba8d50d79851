"""Exact ordered analytics over keys of any size.

A plain ``Window.partitionBy(node).orderBy(ts)`` sends a whole node to one task.
Nothing here does. ``sequence`` numbers the rows of every key with a distributed
range sort, and the other functions cut a key into chunks of ``size`` consecutive
rows, so that the largest unit of work is a chunk however skewed the keys are:

* ``chunked``   adds the neighbouring rows a framed window needs at chunk edges;
* ``running``   combines per-chunk results with a carry from the earlier chunks
                (running sums, maxima, last values);
* ``recurrence`` does the same for first-order linear recurrences.

The carry is a window over one row per chunk, that is rows / ``size`` of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleframe.session import durable

POS = "pos"
CHUNK = "_chunk"
CORE = "_core"
CHUNK_ROWS_CONF = "rippleframe.chunk.rows"
DEFAULT_CHUNK_ROWS = 200_000
LONGEST = "longest_key"
WHOLE = "whole_key"


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", nulls: bool = True) -> DataFrame:
    """Equi-join that keeps the left key columns only.

    Null keys match each other. ``nulls=False`` is for keys known not to be null: a
    plain equality lets the join reuse the partitioning of a window on the same keys.
    """
    right = right.select([F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for name in on:
        same = left[name].eqNullSafe(right[f"__r_{name}"]) if nulls else left[name] == right[f"__r_{name}"]
        cond = cond & same
    return left.join(right, cond, how).drop(*[f"__r_{c}" for c in on])


def sequence(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the 0-based rank of each row within ``key`` by ``order``.

    ``order`` must be unique within a key, and key columns must not be null (the job
    fails otherwise). The global sort range-partitions on (key, order), so a hot key
    spreads over many tasks. Partition-local row ids become ranks by adding the row
    counts of the key's earlier partitions: one row per (key, partition), never one
    per input row. The sorted rows are written out first, since both branches must
    see the same numbering. The column metadata of ``pos`` records the longest key.
    """
    key, order = list(key), list(order)
    for name in key:
        kind = df.schema[name].dataType
        stop = F.raise_error(F.lit(f"null in sequence key {name}")).cast(kind)
        df = df.withColumn(name, F.when(F.col(name).isNull(), stop).otherwise(F.col(name)))
    stored = durable(df.orderBy(*key, *order).withColumn("_rid", F.monotonically_increasing_id()), "sequence")
    stored = stored.withColumn("_shard", F.shiftright("_rid", 33))
    spans = stored.groupBy(*key, "_shard").agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*key).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    seen = Observation()
    spans = durable(spans.observe(seen, F.max(F.col("_base") + F.col("_n")).alias("longest")), "spans")
    longest = seen.get["longest"] or 0
    pos = (F.col("_rid") - F.col("_first") + F.col("_base")).alias(POS, metadata={LONGEST: int(longest)})
    keep = [c for c in stored.columns if c not in ("_rid", "_shard")]
    return attach(stored, spans.drop("_n"), [*key, "_shard"], "inner", nulls=False).select(*keep, pos)


def fits(seq: DataFrame, rows: int) -> bool:
    """Whether every key is known to have at most ``rows`` rows."""
    longest = seq.schema[POS].metadata.get(LONGEST)
    return longest is not None and longest <= rows


def chunked(seq: DataFrame, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Cut each key into chunks of ``size`` rows by ``pos``.

    The last ``before`` rows of a chunk are repeated in the next one and the first
    ``after`` rows in the previous one, flagged ``_core = false``. When no key is
    longer than a chunk there is nothing to repeat.
    """
    size = max(size or chunk_rows(seq), before, after, 1)
    if fits(seq, size):
        only = F.lit(0).cast("bigint").alias(CHUNK, metadata={WHOLE: True})
        return seq.select("*", only, F.lit(True).alias(CORE))
    home = F.floor(F.col(POS) / size)
    if not before and not after:
        return seq.withColumn(CHUNK, home).withColumn(CORE, F.lit(True))
    at = F.pmod(F.col(POS), F.lit(size))
    copies = F.array_compact(
        F.array(
            home,
            F.when(at >= size - before, home + 1),
            F.when((at < after) & (home > 0), home - 1),
        )
    )
    return seq.withColumn(CHUNK, F.explode(copies)).withColumn(CORE, F.col(CHUNK) == home)


def frame(key: Sequence[str]):
    """Window over one chunk in sequence order."""
    return W.partitionBy(*key, CHUNK).orderBy(POS)


def framed(
    seq: DataFrame,
    key: Sequence[str],
    columns: dict,
    before: int = 0,
    after: int = 0,
    size: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``before`` / ``after`` rows away.

    ``columns`` maps a name to a function of the window spec, evaluated in order,
    so a later column may use an earlier one that is row-local to the frame.
    """
    out = chunked(seq, before, after, size)
    w = frame(key)
    for name, build in columns.items():
        out = out.withColumn(name, build(w))
    return out.filter(CORE).drop(CHUNK, CORE)


# How each kind of running aggregate is totalled per chunk, carried over chunks (or
# computed over rows), and joined with the carry.
_TOTAL = {
    "sum": lambda v: F.sum(v),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
    "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col(POS))),
}
_OVER = {
    "sum": lambda v: F.sum(v),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
    "last": lambda v: F.last(v, ignorenulls=True),
}
_JOIN = {
    "sum": lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
    "last": lambda carry, local: F.coalesce(local, carry),
}


def running(
    seq: DataFrame,
    key: Sequence[str],
    columns: dict[str, tuple[str, Column]],
    size: int | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates from the start of the key to the current row.

    ``columns`` maps a name to (kind, expression); kinds are ``sum`` (nulls count
    as zero), ``max``, ``min`` and ``last`` (last non-null value). ``exclusive``
    leaves the current row out. A frame that already has chunks (from ``chunked``
    without neighbours) keeps them, so that several passes share one shuffle.
    """
    key = list(key)
    held = CHUNK in seq.columns
    out = seq if held else chunked(seq, size=size)
    single = out.schema[CHUNK].metadata.get(WHOLE, False)
    for name, (_, expr) in columns.items():
        out = out.withColumn(f"_v_{name}", expr)
    if not single:
        totals = out.groupBy(*key, CHUNK).agg(
            *[_TOTAL[kind](F.col(f"_v_{name}")).alias(f"_t_{name}") for name, (kind, _) in columns.items()]
        )
        prior = W.partitionBy(*key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
        totals = totals.select(
            *key, CHUNK, *[_OVER[kind](F.col(f"_t_{name}")).over(prior).alias(f"_c_{name}") for name, (kind, _) in columns.items()]
        )
    here = frame(key).rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
    out = out.withColumns({f"_v_{name}": _OVER[kind](F.col(f"_v_{name}")).over(here) for name, (kind, _) in columns.items()})
    if not single:
        out = attach(out, totals, [*key, CHUNK], nulls=False)
    for name, (kind, _) in columns.items():
        carry = F.lit(None) if single else F.col(f"_c_{name}")
        out = out.withColumn(name, _JOIN[kind](carry, F.col(f"_v_{name}"))).drop(f"_c_{name}", f"_v_{name}")
    return out if held else out.drop(CHUNK, CORE)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _scan(gains: pd.Series, drives: pd.Series, enter: pd.Series) -> pd.Series:
    """States after each element of ``y = g * y + d``, one list per block."""
    out = []
    for g, d, y in zip(gains, drives, enter):
        states = []
        for gi, di in zip(g.tolist(), d.tolist()):
            y = gi * y + di
            states.append(y)
        out.append(states)
    return pd.Series(out)


def recurrence(
    seq: DataFrame,
    key: Sequence[str],
    name: str,
    gain: Column,
    drive: Column,
    block: int = 4096,
) -> DataFrame:
    """Add ``name`` with ``y[t] = gain[t] * y[t-1] + drive[t]`` and ``y[-1] = 0``.

    A block of rows acts on the state as one affine map ``y_out = a * y_in + b``.
    Blocks are folded to (a, b) pairs, groups of blocks to one pair again, and the
    states flow back down: no task holds more than ``block`` rows of a key, or one
    pair per ``block`` squared rows at the top.
    """
    key = list(key)
    payload = [c for c in seq.columns if c not in key and c != POS]
    blocks = _affine_groups(
        seq.withColumn("_a", gain.cast("double")).withColumn("_o", drive.cast("double")),
        key, POS, "_b", block, payload,
    )
    if fits(seq, block):
        rows = blocks.withColumn("_enter", F.lit(0.0))
    else:
        groups = _affine_groups(blocks.select(*key, "_b", "_a", "_o"), key, "_b", "_s", block)
        tops = _affine_groups(groups.select(*key, "_s", "_a", "_o"), key, "_s", "_t", None)
        enter_groups = _states(tops.withColumn("_enter", F.lit(0.0)), key, "_s")
        enter_blocks = _states(attach(groups, enter_groups, [*key, "_s"], nulls=False), key, "_b")
        rows = attach(blocks, enter_blocks, [*key, "_b"], nulls=False)
    ys = _scan(F.col("_items._a"), F.col("_items._o"), F.col("_enter"))
    return (
        rows.withColumn("_ys", ys)
        .select(*key, F.explode(F.arrays_zip("_items", "_ys")).alias("_e"))
        .select(*key, f"_e._items.{POS}", *[f"_e._items.{c}" for c in payload], F.col("_e._ys").alias(name))
    )


def _affine_groups(df, key, index, group, size, payload=()):
    """Collect maps in groups of ``size`` consecutive indices, with their composition."""
    number = F.floor(F.col(index) / size) if size else F.lit(0)
    items = F.sort_array(F.collect_list(F.struct(index, "_a", "_o", *payload)))
    fold = F.aggregate(
        "_items",
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("o")),
        lambda acc, m: F.struct((acc["a"] * m["_a"]).alias("a"), (acc["o"] * m["_a"] + m["_o"]).alias("o")),
    )
    return (
        df.groupBy(*key, number.alias(group))
        .agg(items.alias("_items"))
        .withColumn("_f", fold)
        .select(*key, group, "_items", F.col("_f.a").alias("_a"), F.col("_f.o").alias("_o"))
    )


def _states(df, key, index):
    """One row per item with the state entering it."""
    ys = _scan(F.col("_items._a"), F.col("_items._o"), F.col("_enter"))
    before = F.concat(F.array("_enter"), F.slice("_ys", 1, F.size("_ys") - 1))
    return (
        df.withColumn("_ys", ys)
        .select(*key, F.explode(F.arrays_zip(F.col(f"_items.{index}").alias("i"), before.alias("y"))).alias("_e"))
        .select(*key, F.col("_e.i").alias(index), F.col("_e.y").alias("_enter"))
    )
