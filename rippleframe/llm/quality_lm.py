"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model works on characters: 12 bits a symbol, so that an n-gram of order 5 is one
exact number, and its table grows with the corpus. Counts of all trusted text are summed
in tasks, then by n-gram; continuation counts, context sums and the interpolation with
the next lower order are grouped sums and equi-joins, sharded by n-gram and context.

Documents are dealt into blocks of bounded size. The distinct n-grams of a block meet the
model in one sharded join, and the entries found return to the block, where they give
each document's perplexity: n-grams are shuffled once per block and not once per use, and
no task or driver ever holds the model. The perplexity is compared with a quantile of
the trusted documents of the same language that the model was not trained on: a model
this large fits its own text better than new text of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.llm.base import attach_small, give_back, keeps_names, lean, text_batches
from rippleframe.session import durable

ORDER = 5
#: Bits of a symbol; five symbols and the tag of a key fill 64 bits.
BITS = 12
SYMBOLS = 1 << BITS
QUANTILE = 0.995
#: Perplexities are compared as natural logarithms in these steps.
STEP = 1e-4
#: Codes gathered in a task before they are counted or scored.
TALLY = 4_000_000
#: Bytes of text in a block, which one task scores.
BLOCK_BYTES = 64 << 20
#: Discounts of an order whose counts are too few or too regular to estimate them.
FALLBACK = (0.5, 1.0, 1.5)
#: One trusted text in this many, chosen by its hash, sets thresholds and is not trained on.
CALIBRATION = 5
#: Ids of trusted documents are broadcast up to this many, else the join shuffles.
BROADCAST_IDS = 2_000_000


def alphabet() -> np.ndarray:
    """Symbol of every code point: 0 line feed and text ends, one for A-Z, one for digits, other code points below 2048
    stand for themselves, those above share 2048 symbols by remainder."""
    table = np.arange(0x110000, dtype=np.uint64)
    table[2048:] = 2048 + table[2048:] % 2048
    table[65:91], table[48:58], table[10] = 65, 48, 0
    return table


def gram_codes(text: str, table: np.ndarray, order: int) -> np.ndarray:
    """Codes of all n-grams that end at a character of ``text`` or at its end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = np.zeros(len(points) + order, dtype=np.uint64)
    x[order - 1 : -1] = table[points]
    code = x[: len(points) + 1].copy()
    for k in range(1, order):
        code <<= np.uint64(BITS)
        code |= x[k : k + len(points) + 1]
    return code


def _tally(parts: list[np.ndarray]) -> pa.RecordBatch:
    codes = np.sort(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    counts = np.diff(np.append(first, len(codes)))
    return pa.RecordBatch.from_arrays([pa.array(codes[first].astype(np.int64)), pa.array(counts.astype(np.int64))], names=["gram", "n"])


def _counter(order: int):
    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parts, size = alphabet(), [], 0
        for batch in batches:
            for text in batch.column(0):
                if t := text.as_py():
                    parts.append(gram_codes(t, table, order))
                    size += len(parts[-1])
                if size > TALLY:  # partial counts keep memory bounded; Spark adds them up
                    yield _tally(parts)
                    parts, size = [], 0
        yield _tally(parts)

    return run


def gram_counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all of ``trusted``'s texts."""
    parts = text_batches(trusted).select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(order), "gram bigint, n bigint")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; ``FALLBACK`` where the counts of counts give none."""
    n = counts.agg(*[F.coalesce(F.sum(F.when(F.col("n") == k, 1).otherwise(0)), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not all(n.asDict().values()):
        return list(FALLBACK)
    y = n["n1"] / (n["n1"] + 2 * n["n2"])
    found = [k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"] for k in (1, 2, 3)]
    return found if all(0 < d <= k for k, d in enumerate(found, start=1)) else list(FALLBACK)


def levels(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Per order from 1 up: (gram, context, p, gamma) of the seen n-grams, gamma being the backed-off mass of their context.

    A lower order's n-gram counts the distinct symbols that precede it.
    """
    by_order = {order: durable(counts, "grams")}
    for m in range(order - 1, 0, -1):
        by_order[m] = durable(by_order[m + 1].groupBy(F.col("gram").bitwiseAND(_mask(m)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    out: list[DataFrame] = []
    for m in range(1, order + 1):
        d = discounts(by_order[m])
        kind = F.least("n", F.lit(3))
        cut = F.element_at(F.array(*map(F.lit, d)), kind.cast("int"))
        rows = by_order[m].select("gram", "n", F.shiftright("gram", BITS).alias("context"), F.col("gram").bitwiseAND(_mask(m - 1)).alias("suffix"), cut.alias("cut"))
        # Whole numbers are summed, so the result does not depend on the order of the rows.
        ones, twos, more = (F.count(F.when(F.least("n", F.lit(3)) == k, 1)) for k in (1, 2, 3))
        free = ones * F.lit(d[0]) + twos * F.lit(d[1]) + more * F.lit(d[2])
        sums = rows.groupBy(F.col("context").alias("c")).agg((free / F.sum("n")).alias("gamma"), F.sum("n").alias("total"))
        rows = rows.join(sums, rows["context"] == sums["c"])
        if m == 1:
            rows = rows.withColumn("low", F.lit(1.0 / SYMBOLS))
        else:
            low = out[-1].select(F.col("gram").alias("s"), F.col("p").alias("low"))
            rows = rows.join(low, rows["suffix"] == low["s"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("low")
        out.append(durable(rows.select("gram", "context", p.alias("p"), "gamma"), "level"))
    return out


def _mask(m: int) -> int:
    return (1 << BITS * m) - 1


def _tag(m: int, gamma: bool) -> int:
    """Top four bits of a key, as a signed number: the order and whether it asks for a context's gamma."""
    return (m << 60) - (1 << 63) * gamma


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): probabilities by n-gram and backed-off masses by context, all orders in one table."""
    parts = []
    for m, level in enumerate(levels(counts, order), start=1):
        parts.append(level.select(F.col("gram").bitwiseOR(F.lit(_tag(m, False))).alias("key"), F.col("p").alias("value")))
        parts.append(level.groupBy(F.col("context").bitwiseOR(F.lit(_tag(m, True))).alias("key")).agg(F.min("gamma").alias("value")))
    return durable(reduce(DataFrame.unionByName, parts), "model")


def _keys(grams: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order from 1 up: the keys of the n-grams' ends of that order and of their contexts."""
    for m in range(1, order + 1):
        end = (grams & np.uint64(_mask(m))).view(np.int64)
        yield end | np.int64(_tag(m, False)), (end >> np.int64(BITS)) | np.int64(_tag(m, True))


def log_probability(grams: np.ndarray, keys: np.ndarray, values: np.ndarray, order: int) -> np.ndarray:
    """Natural log probability of n-grams; ``keys`` are sorted and hold what the model has of them."""
    p = np.full(len(grams), 1.0 / SYMBOLS)

    def find(wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if not len(keys):
            return np.broadcast_to(other, wanted.shape)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    for seen, context in _keys(grams, order):
        p = find(seen, find(context, 1.0) * p)
    return np.log(np.maximum(p, 1e-30))


def _block_keys(order: int):
    def asked(block: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        grams = pd.unique(np.concatenate(parts))
        keys = np.concatenate([pd.unique(k) for both in _keys(grams, order) for k in both])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, dtype=np.int32)), pa.array(keys)], names=["__block", "key"])

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = alphabet(), {}, {}
        for batch in batches:
            for block, text in zip(batch.column("__block").to_pylist(), batch.column("text"), strict=True):
                if not (t := text.as_py()):
                    continue
                parts = held.setdefault(block, [])
                parts.append(gram_codes(t, table, order))
                size[block] = size.get(block, 0) + len(parts[-1])
                if sum(size.values()) > TALLY:  # only distinct codes stay
                    held = {b: [pd.unique(np.concatenate(p))] if size[b] else p for b, p in held.items()}
                    size = dict.fromkeys(held, 0)
                    if sum(len(p[0]) for p in held.values()) > 2 * TALLY:  # a key asked twice is answered twice
                        yield from (asked(b, p) for b, p in held.items())
                        held, size = {}, {}
        yield from (asked(b, p) for b, p in held.items())

    return run


def _score_block(names: Sequence[str], order: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        table = alphabet()
        keys, at = np.unique(found.column("key").to_numpy(), return_index=True)
        values = found.column("value").to_numpy()[at]
        steps, parts, rows, size = np.full(docs.num_rows, np.nan), [], [], 0

        def settle() -> None:
            which, grams = pd.factorize(np.concatenate(parts))
            logs = log_probability(grams, keys, values, order)[which]
            length = np.array([len(p) for p in parts])
            sums = np.add.reduceat(logs, np.cumsum(length) - length)
            steps[rows] = np.round(-sums / length / STEP)

        for row, text in enumerate(v for chunk in docs.column("text").chunks for v in chunk):
            if t := text.as_py():
                parts.append(gram_codes(t, table, order)), rows.append(row)
                size += len(parts[-1])
            if size > TALLY:
                settle()
                parts, rows, size = [], [], 0
        if parts:
            settle()
        step = pa.array(steps, pa.float64(), from_pandas=True).cast(pa.int64())
        del keys, at, values, parts
        give_back()
        return docs.select([*names, "__trusted"]).append_column("__step", step)

    return run


def scores(docs: DataFrame, trusted: DataFrame, names: Sequence[str], order: int = ORDER) -> DataFrame:
    """Columns ``names`` of every row with ``__trusted`` and ``__step``, the log perplexity in steps (null without text).

    ``trusted`` has the ids of the trusted documents as ``__id``; ``__trusted`` is null for
    the others, true for those kept out of training. The result is stored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(-(-total // BLOCK_BYTES), 2 * spark.sparkContext.defaultParallelism)
    # Rows that are equal throughout still spread, by the part of the input they come from.
    block = F.pmod(F.xxhash64("doc_id", text) + F.spark_partition_id(), F.lit(blocks)).cast("int")
    marked = text_batches(docs).withColumn("__block", block).join(trusted, docs["doc_id"] == trusted["__id"], "left")
    columns = dict.fromkeys(["__block", *names, "text"])
    aside = F.coalesce(F.pmod(F.xxhash64(text), F.lit(CALIBRATION)) == 0, F.lit(True))
    marked = marked.withColumn("__trusted", F.when(F.col("__id").isNotNull(), aside)).select(*[text.alias("text") if c == "text" else c for c in columns], "__trusted")
    known = docs.where(~aside).join(trusted, docs["doc_id"] == trusted["__id"], "left_semi")
    entries = model(durable(gram_counts(known, order), "counts"), order)
    # Both uses need the same columns, so Spark shuffles the texts once and reads them twice.
    dealt = marked.repartition("__block")
    asked = dealt.mapInArrow(_block_keys(order), "__block int, key bigint")
    found = asked.join(entries, "key").select("__block", "key", F.col("value").cast("double").alias("value"))
    out = marked.select(*names, "__trusted").withColumn("__step", F.lit(None).cast("long")).schema
    return durable(dealt.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(_score_block(names, order), out), "scores")


def thresholds(bins: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, limit) from a histogram (lang, step, n): the smallest step at or over the quantile of each language.

    Steps of ``STEP`` bound a language's histogram; the result is exact for them.
    """
    up, whole = W.partitionBy("lang").orderBy("step"), W.partitionBy("lang")
    ranked = bins.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(whole))
    return ranked.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg(F.min("step").alias("limit"))


def _unseen(bins: DataFrame) -> DataFrame:
    """Of each language the counts of documents kept out of training, or all if there are none."""
    some = F.max("aside").over(W.partitionBy("lang"))
    return bins.withColumn("some", some).where("aside = some").drop("aside", "some")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that ``labels`` marks with quality 1."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()


@keeps_names
def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``perplexity``, ``threshold`` and ``keep``; columns of these names are replaced.

    ``labels`` (doc_id, quality) marks trusted documents with quality 1; of these one text in
    ``CALIBRATION`` sets the thresholds and the others train the model. A null language is
    a language of its own; one without trusted documents takes the threshold of all
    trusted ones together. Without trusted text nothing can be judged: all three columns
    but ``keep`` are null and every document with text is kept. A null or empty text has a
    null perplexity and is not kept. Repeated rows are judged alike. ``columns`` names the
    columns of ``docs`` to return, all if None; texts that are not asked for are not stored.
    """
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("perplexity", "threshold", "keep")]
    ids = durable(trusted_ids(labels), "trusted")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    scored = scores(docs, ids, list(dict.fromkeys([*names, "lang"])), order)
    known = scored.where("__trusted is not null and __step is not null").select(F.col("lang").cast("string").alias("lang"), F.col("__step").alias("step"), F.col("__trusted").alias("aside"))
    bins = durable(known.groupBy("lang", "step", "aside").agg(F.count(F.lit(1)).alias("n")), "histogram")
    limits = thresholds(_unseen(bins), quantile).withColumnRenamed("limit", "__limit")
    pooled = bins.groupBy(F.lit("").alias("lang"), "step", "aside").agg(F.sum("n").alias("n"))
    overall = thresholds(_unseen(pooled), quantile).first()
    untrained = overall is None
    judged = attach_small(scored, limits, "lang", ["__limit"])
    limit = F.coalesce("__limit", F.lit(None if untrained else overall["limit"]).cast("long"))
    has_text = F.col("__step").isNotNull()
    return judged.select(
        *names,
        (F.exp(F.col("__step") * STEP) if not untrained else F.lit(None).cast("double")).alias("perplexity"),
        F.exp(limit * STEP).alias("threshold"),
        (has_text & F.coalesce(F.col("__step") <= limit, F.lit(True))).alias("keep"),
    )


@keeps_names
def filter_documents(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    return judge(docs, labels, order, quantile).where("keep").select(*docs.columns)
