"""Tiered, quantised frame history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.vectors import let
from rippleframe.operators.sequence import POS, attach


def quantize(values: Column, bits: int) -> Column:
    """Struct (codes, low, scale): affine codes, halves to even; low and scale are float32."""
    levels = (1 << bits) - 1

    def encode(e):
        scale = (e["hi"] - e["lo"]) / levels
        flat = scale <= 0
        codes = F.transform(values, lambda x: F.when(flat, F.lit(0)).otherwise(F.bround((x - e["lo"]) / scale).cast("int")))
        f32 = lambda c: c.cast("float").cast("double")
        return F.struct(codes.alias("codes"), f32(e["lo"]).alias("low"), f32(scale).alias("scale"))

    return let(F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi")), encode)


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["low"] + c * q["scale"])


def through(values: Column, bits: Sequence[int]) -> Column:
    """Values after being stored at each bit width in turn, as ageing frames are."""
    for width in bits:
        values = let(quantize(values, width), dequantize)
    return values


def packed_bytes(count: Column, bits: Column) -> Column:
    return F.ceil(count * bits / 8)


def tiers(
    seq: DataFrame, key: Sequence[str], vector: str, capacity: int | None = None, hot: int = 10, warm: int = 300, bits: tuple[int, int, int] = (8, 6, 3)
) -> DataFrame:
    """All frames with tier, bit width and reconstruction; only the newest ``capacity`` of a key if one is given."""
    last = seq.groupBy(*key).agg((F.max(POS)).alias("_last"))
    rows = attach(seq, last, list(key)).withColumn("age", F.col("_last") - F.col(POS)).drop("_last")
    if capacity is not None:
        rows = rows.filter(F.col("age") < capacity)
    is_hot, is_warm = F.col("age") < hot, F.col("age") < hot + warm
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = rows.withColumn("tier", F.when(is_hot, "hot").when(is_warm, "warm").otherwise("cold"))
    rows = rows.withColumn("bits", F.when(is_hot, bits[0]).when(is_warm, bits[1]).otherwise(bits[2]))
    restored = F.when(is_hot, through(v, bits[:1])).when(is_warm, through(v, bits[:2])).otherwise(through(v, bits))
    return rows.withColumn("restored", restored)
