"""Named queries over the driver tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def register(fn):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"duplicate query {fn.__name__}")
        REGISTRY[fn.__name__] = Query(fn, sql)
        return fn

    return register


class Tables:
    """Attribute access to the Parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def r6(value: Column | str, digits: int = 6) -> Column:
    """Round for comparison with SQL; adding 0.0 turns -0.0 into 0.0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits) + F.lit(0.0)


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * 86_400_000_000
        + F.hour(ts).cast("bigint") * 3_600_000_000
        + F.minute(ts).cast("bigint") * 60_000_000
        + second
    )
