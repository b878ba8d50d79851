"""Change logs of entities folded to a table of states, as of any time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.operators import sequence as seqs

#: Entity ids are a domain and a name (fixed value).
ENTITY = r"^[a-z0-9_]+\.[a-z0-9_]+$"


def valid_entity(entity: Column) -> Column:
    return F.coalesce(entity.rlike(ENTITY), F.lit(False))


def domain(entity: Column) -> Column:
    return F.substring_index(entity, ".", 1)


def changes(log: DataFrame, entity: str, state: str, attributes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``log`` with pos, removed, published and changed of every row in the order of its entity.

    A row with a null state removes the entity. ``published``: the row makes an event, that is the entity appears, its
    state or attributes become others, or it is removed while it is there. ``changed``: the state itself
    became another. Rows whose entity is not ``domain.name`` are left out. ``order`` is unique
    within an entity. Any skew of entities is spread, since only the row before is looked at.
    """
    attributes = list(attributes)
    seq = seqs.sequence(log.where(valid_entity(F.col(entity))), [entity], order)
    values = F.struct(state, *attributes)
    out = seqs.framed(seq, [entity], {"_before": lambda w: F.lag(values).over(w)}, before=1)
    before = F.col("_before")
    gone, was_gone = F.col(state).isNull(), before.isNull() | before[state].isNull()
    same = F.lit(True)
    for c in attributes:
        same = same & F.col(c).eqNullSafe(before[c])
    changed = F.when(gone | was_gone, ~(gone & was_gone)).otherwise(F.col(state) != before[state])
    out = out.withColumn("removed", gone).withColumn("changed", changed)
    return out.withColumn("published", F.col("changed") | (~gone & ~was_gone & ~same)).drop("_before")


def table(log: DataFrame, entity: str, state: str, attributes: Sequence[str], time: str, order: Sequence[str], as_of: Column | None = None) -> DataFrame:
    """entity, domain, state, attributes, last_changed, last_updated and events of every entity that is there ``as_of`` a time.

    The last row of an entity up to then counts; an entity whose last row removed it is absent. ``last_changed`` is when the
    state took its value, ``last_updated`` the time of the last row, ``events`` how many rows made an event since the
    log began. One row per entity leaves each task.
    """
    known = log if as_of is None else log.where(F.col(time) <= as_of)
    steps = changes(known, entity, state, attributes, order)
    last = F.max_by(F.struct("removed", state, *attributes, F.col(time).alias("last_updated")), "pos")
    folded = steps.groupBy(entity).agg(
        last.alias("last"), F.max_by(time, F.when(F.col("changed") & ~F.col("removed"), F.col("pos"))).alias("last_changed"), F.count_if("published").alias("events"),
    )
    there = folded.where(~F.col("last.removed"))
    return there.select(entity, domain(F.col(entity)).alias("domain"), *[F.col(f"last.{c}").alias(c) for c in (state, *attributes)], "last_changed", "last.last_updated", "events")


def in_domain(states: DataFrame, name: str) -> DataFrame:
    """The states of one domain."""
    return states.where(F.col("domain") == name)
