"""Mixing sources to target weights. DataFrame functions only.

Sources share a multiple of all tokens by weight. No source gets more than ``max_rate``
times its own tokens; what it cannot take is shared again by weight among the others.
Each document is emitted floor(rate) times, plus one copy with probability equal to the
fraction, drawn from a hash of its id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.llm.base import WORD, attach_small
from rippleframe.session import durable

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_RATE = 2.0
SEED = 42


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add ``rank``, the 0-based place of each source by code point, null last.

    A range sort numbers the sources, so that no task needs all of them.
    """
    ordered = durable(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__rid", F.monotonically_increasing_id()), "sources")
    ordered = ordered.withColumn("__shard", F.shiftright("__rid", 33))
    spans = ordered.groupBy("__shard").agg(F.min("__rid").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = W.orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)  # a row per task
    spans = spans.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).withColumnRenamed("__shard", "__s")
    placed = ordered.join(spans, ordered["__shard"] == spans["__s"])
    return placed.select(*sources.columns, (F.col("__base") + F.col("__rid") - F.col("__first")).alias("rank"))


def targets(sources: DataFrame, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """Add ``target`` to (source, source_size, weight) rows.

    Each round caps the sources above their limit and shares the rest again: only two
    sums per round reach the driver. The level only rises, so capped sources stay capped
    and the loop ends.
    """
    limit = F.col("source_size") * F.lit(float(max_rate))
    whole = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    amount, level, capped = share * whole, 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > limit
        row = sources.agg(
            F.sum(F.when(over, limit).otherwise(F.lit(0.0))).alias("fixed"),
            F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("weight"))).alias("weight"),
            F.sum(F.when(over, 1).otherwise(0)).alias("n"),
        ).first()
        if row["n"] is None or row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (amount - row["fixed"]) / row["weight"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), limit))


def copies(doc_id: Column, rate: Column, seed: int = SEED) -> Column:
    """floor(rate) plus one hash-seeded Bernoulli copy. A null id draws as the text 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target and copies of every document row, and the columns in ``keep``.

    ``weights`` repeat over the sources in code point order, null last. Texts that are
    null, empty or blank have size 0. A source without words has target 0 and its
    documents get no copy. Rows that repeat an id draw alike. An empty table gives an
    empty result.
    """
    own = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("__kept") if keep else F.lit(None).alias("__kept"),
        "doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"),
    )
    sources = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ranked_sources(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    table = durable(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    table = targets(table, share, max_rate)
    both = attach_small(own, table, "source", ["source_size", "target"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return both.withColumn("copies", copies(F.col("doc_id"), rate, seed))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated as planned; rows without a copy are not emitted."""
    planned = plan(docs, weights, share, max_rate, seed, keep=docs.columns).where("copies > 0")
    emitted = planned.select("__kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return emitted.select(*[F.col("__kept").getField(c).alias(c) for c in docs.columns])
