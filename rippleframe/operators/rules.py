"""Automation rules compiled to column predicates.

A rule is plain data. All rules are evaluated in one pass over the events: each
becomes one boolean column expression, and the matching rule ids one array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``triggers``: any must match; ``conditions``: all must hold.

    Trigger and condition items are dicts: ``{"state": x}`` with optional ``from``,
    ``{"above": a, "below": b}``, ``{"event": name}``, ``{"time": "..."}`` (never
    fires by itself), ``{"template": text}``, ``{"and" | "or" | "not": [...]}``.
    """

    rule_id: str
    triggers: Sequence[dict]
    conditions: Sequence[dict] = field(default_factory=tuple)
    enabled: bool = True
    ignore_first: bool = False


def compile_item(item: dict, state: Column, old: Column, number: Column, event: Column) -> Column:
    again = lambda children: [compile_item(c, state, old, number, event) for c in children]
    if "and" in item:
        return reduce(lambda a, c: a & c, again(item["and"]), F.lit(True))
    if "or" in item:
        return reduce(lambda a, c: a | c, again(item["or"]), F.lit(False))
    if "not" in item:
        return ~reduce(lambda a, c: a | c, again(item["not"]), F.lit(False))
    if "template" in item:
        return F.lit(item["template"].strip().lower() in {"1", "true", "yes", "on"})
    if "event" in item:
        return event == item["event"]
    if "time" in item:
        return F.lit(False)
    if "state" in item:
        hit = state == item["state"]
        return hit & (F.coalesce(old, F.lit("unavailable")) == item["from"]) if "from" in item else hit
    hit = number.isNotNull()
    if item.get("above") is not None:
        hit = hit & (number > item["above"])
    if item.get("below") is not None:
        hit = hit & (number < item["below"])
    return F.coalesce(hit, F.lit(False))


def evaluate(
    events: DataFrame, rules: Sequence[Rule], state: str, old: str, number: str, event: str, order: Sequence[str]
) -> DataFrame:
    """One row per (event, fired rule).

    An ignore-first rule skips its first trigger in ``order``. That first event is
    the minimum over all triggers of the rule, an aggregate, not an ordered scan.
    """
    cols = [F.col(c) for c in (state, old, number, event)]
    live = [r for r in rules if r.enabled]

    def hit(rule):
        trig = reduce(lambda a, c: a | c, [compile_item(t, *cols) for t in rule.triggers], F.lit(False))
        cond = reduce(lambda a, c: a & c, [compile_item(c, *cols) for c in rule.conditions], F.lit(True))
        return F.when(F.coalesce(trig, F.lit(False)), F.struct(F.lit(rule.rule_id).alias("rule_id"), F.coalesce(cond, F.lit(False)).alias("run")))

    hits = events.withColumn("_hit", F.explode(F.array_compact(F.array(*[hit(r) for r in live]))))
    hits = hits.select("*", "_hit.*").drop("_hit")
    waiting = [r.rule_id for r in live if r.ignore_first]
    if waiting:
        when = F.struct(*order)
        first = hits.filter(F.col("rule_id").isin(waiting)).groupBy("rule_id").agg(F.min(when).alias("_first"))
        # At most one row per rule of the rule list.
        hits = hits.join(F.broadcast(first), "rule_id", "left").filter(F.col("_first").isNull() | (when != F.col("_first")))
        hits = hits.drop("_first")
    return hits.filter("run").drop("run")
