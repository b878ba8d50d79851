"""Shared pieces: bounded broadcasts, work units of bounded size and batch iteration."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.session import durable

#: White space of the text contracts: space and the five ASCII controls from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: A side with more rows than this is never broadcast by hand.
BROADCAST_ROWS = 10_000


#: Rows of text per Arrow batch: texts are long, and a batch is held in the JVM and in the worker at once.
TEXT_ROWS = 2000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batch size for texts if it still is Spark's default."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(TEXT_ROWS))
    return df


def give_back() -> None:
    """Return memory that the Python worker has freed to the system; it serves other tasks or waits, beside a JVM with a full heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library keeps freed memory this long
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a task, with ``give_back`` at its end."""

    @functools.wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let a table have columns whose names start with two underscores, as those inside the operators do.

    Such columns of the first argument pass through the operator under other names, so they
    come back with their names and values. Names in ``columns`` are those of the table.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        aside = {c: f"user {c}" for c in docs.columns if c.startswith("__")}
        if not aside:
            return operator(docs, *args, **kwargs)
        if kwargs.get("columns") is not None:
            kwargs["columns"] = [aside.get(c, c) for c in kwargs["columns"]]
        out = operator(docs.withColumnsRenamed(aside), *args, **kwargs)
        return out.withColumnsRenamed({new: old for old, new in aside.items()})

    return run


def attach_small(df: DataFrame, side: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Left join on one null-safe key; ``side`` is broadcast only if its counted rows are few.

    ``side`` has one row per key. Beyond the limit the join shuffles, and Spark splits
    a hot key of ``df`` at run time.
    """
    side = side.select(F.col(on).alias("__key"), *columns)
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, df[on].eqNullSafe(side["__key"]), "left").drop("__key")


def text_hash(text: str) -> Column:
    """64 bits that tell texts apart, null from any other."""
    own = F.col(text).cast("string")
    return F.xxhash64(own, own.isNull())


def keep_smallest(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """``docs`` with one row of each root of ``rooted`` (doc_id, text_hash, root of every row).

    The row of the smallest doc_id stays, then of the smallest text hash; a null doc_id
    is the largest. Rows are told apart by doc_id and text together; of rows that agree
    in both one stays.
    """
    each = rooted.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("__rows"))
    least = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash", "__rows")).alias("b"))
    kept = durable(least.select(F.col("b.doc_id").alias("__id"), F.col("b.text_hash").alias("__h"), F.col("b.__rows").alias("__rows")), "kept")
    # Semi-join sides hold keys only; hashing them spares a sort of the texts.
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (text_hash("text") == F.col("__h"))
    once = docs.join(kept.where("__rows = 1").hint("shuffle_hash"), same, "left_semi")
    if kept.where("__rows > 1").isEmpty():
        return once
    return once.unionByName(docs.join(kept.where("__rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def units(rows: DataFrame, key: str, item: str, size: int) -> DataFrame:
    """Cut the rows of each key into work units of about ``2 * size`` rows at most.

    A key with more than ``size`` rows is hashed by ``item`` into blocks, and each pair
    of blocks is a unit, so any two rows of the key meet in some unit and no task ever
    holds a whole hot key. Rows must be stored: they are read twice. Adds the unit's blocks
    ``__i`` <= ``__j`` and the row's own block ``__home``: rows of one block meet in every
    unit of that block. The result is dealt out and sorted by unit.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > size)
    hot = hot.select(F.col(key).alias("__k"), F.ceil(F.col("__n") / size).cast("int").alias("__blocks"))
    sized = rows.join(hot, rows[key] == hot["__k"], "left").drop("__k")
    blocks = F.coalesce("__blocks", F.lit(1))
    home = F.pmod(F.xxhash64(item), blocks).cast("int")
    sized = sized.withColumn("__home", home).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    paired = sized.withColumn("__i", F.least("__home", "__other")).withColumn("__j", F.greatest("__home", "__other"))
    paired = paired.drop("__other", "__blocks")
    return paired.repartition(key, "__i", "__j").sortWithinPartitions(key, "__i", "__j")


def _gathered(batches: Iterable[pa.RecordBatch], rows: int = 10_000) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at least ``rows`` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield held
            held = []
    if held:
        yield held


def whole_units(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Join batches so that no unit is cut: yields a table and the unit number of its rows.

    ``names`` are the unit's key columns, by which the input is sorted.
    """
    rest: pa.Table | None = None
    for gathered in _gathered(batches):
        table = pa.Table.from_batches(gathered)
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        change = np.zeros(table.num_rows, dtype=bool)
        for name in names:
            v = table.column(name).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks(), np.cumsum(change[:cut])
        rest = table.slice(cut)
    if rest is not None:
        yield rest.combine_chunks(), np.zeros(rest.num_rows, dtype=np.int64)


def neighbours(unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs inside equal runs of ``unit``, one distance at a time."""
    last = np.flatnonzero(np.append(unit[1:] != unit[:-1], True))
    end = last[np.searchsorted(last, np.arange(len(unit)))] + 1
    left, step = np.arange(len(unit)), 1
    while True:
        left = left[left + step < end[left]]
        if not len(left):
            return
        yield left, left + step
        step += 1


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest member of each connected set of the links ``a``-``b``: (node, smallest), without the roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        before = parent.copy()
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        if np.array_equal(before, parent):
            break
    inner = parent != np.arange(len(nodes))
    return nodes[inner], nodes[parent[inner]]


class Links:
    """Collects verified links of a task and hands on only a spanning star of each local set."""

    def __init__(self, limit: int = 500_000):
        self.limit, self.size, self.parts = limit, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.size += len(a)
            if self.size > self.limit:
                self.parts = [self.stars()]
                self.size = 0

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            none = np.empty(0, dtype=np.int64)
            return none, none
        return contract(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column without nulls as doubles, padded with zeros to ``width``."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width))
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def finite(column: str) -> Column:
    """Whether an array column is not null and holds only finite numbers."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(good, F.lit(False))
