"""Positions refined by ranges, and ranges assigned to tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import ranging
from rippleframe.plans.registry import Tables, query, r6

# A tag per order near (20, 25, 1.5); each line item is an anchor on the floor that measured its range.
TAGS = """c AS (SELECT l_orderkey AS tag, l_linenumber AS anchor, l_quantity AS ax, (l_partkey % 50)::DOUBLE AS ay, 0.3 + l_tax AS sigma,
  sqrt((l_quantity - 20)^2 + (l_partkey % 50 - 25)^2 + 2.25) * (1 + (l_discount - 0.05) * 0.3) AS measured FROM lineitem),
o AS (SELECT c.*, abs(sqrt((21 - ax)^2 + (24.5 - ay)^2 + 1) - measured) / sigma AS off FROM c)"""


def _tags(spark, sf_dir):
    y = (F.col("l_partkey") % 50).cast("double")
    d = F.sqrt(F.pow(F.col("l_quantity") - 20, 2) + F.pow(y - 25, 2) + 2.25)
    constraints = Tables(spark, sf_dir).lineitem.select(
        F.col("l_orderkey").alias("tag"), F.col("l_linenumber").alias("anchor"), F.col("l_quantity").alias("ax"), y.alias("ay"), F.lit(0.0).alias("az"),
        (d * (1 + (F.col("l_discount") - 0.05) * 0.3)).alias("measured"), (0.3 + F.col("l_tax")).alias("sigma"),
    )
    tags = constraints.select("tag").distinct()
    return tags.select("tag", F.lit(21.0).alias("x"), F.lit(24.5).alias("y"), F.lit(1.0).alias("z")), constraints


@query(
    f"""WITH RECURSIVE {TAGS}, a AS (SELECT * FROM o WHERE off <= 3),
k AS (SELECT tag, list({{'ax': ax, 'ay': ay, 'm': measured, 'w': 1 / sigma^2}} ORDER BY anchor) AS c, sum(1 / sigma^2) AS w FROM a GROUP BY tag),
s(tag, c, w, i, x, y, z, moved) AS (SELECT tag, c, w, 0, 21.0::DOUBLE, 24.5::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM k
  UNION ALL SELECT tag, c, w, i + 1, x - mx, y - my, z - mz, sqrt(mx * mx + my * my + mz * mz) FROM
  (SELECT *, list_sum(list_transform(g, lambda v: v.g * (x - v.ax))) / w AS mx, list_sum(list_transform(g, lambda v: v.g * (y - v.ay))) / w AS my, list_sum(list_transform(g, lambda v: v.g)) * z / w AS mz
   FROM (SELECT *, list_transform(c, lambda v: {{'g': v.w * (1 - v.m / greatest(sqrt((x - v.ax)^2 + (y - v.ay)^2 + z^2), 1e-9)), 'ax': v.ax, 'ay': v.ay}}) AS g FROM s WHERE moved >= 1e-4 AND i < 200))),
e AS (SELECT tag, arg_max(x, i) AS x, arg_max(y, i) AS y, arg_max(z, i) AS z FROM s GROUP BY tag),
r AS (SELECT e.tag, sqrt(avg(((sqrt((e.x - ax)^2 + (e.y - ay)^2 + e.z^2) - measured) / sigma)^2)) AS rms FROM e JOIN a USING (tag) GROUP BY e.tag)
SELECT n.tag, round(coalesce(x, 21), 5) AS x, round(coalesce(y, 24.5), 5) AS y, round(coalesce(abs(z), 1), 5) AS height, admitted, rejected, round(rms, 5) AS rms
FROM (SELECT tag, count(*) FILTER (off <= 3) AS admitted, coalesce(string_agg(anchor, ',' ORDER BY anchor) FILTER (off > 3), '') AS rejected FROM o GROUP BY tag) n LEFT JOIN e USING (tag) LEFT JOIN r USING (tag)"""
)
def range_refine(spark, sf_dir):
    """Tag positions refined from a rough guess by the ranges that fit it."""
    tags, constraints = _tags(spark, sf_dir)
    out = ranging.refine(tags, constraints, ["tag"])
    return out.select(
        "tag", r6("x", 5).alias("x"), r6("y", 5).alias("y"), r6(F.abs("z"), 5).alias("height"), "admitted", F.array_join("rejected", ",").alias("rejected"), r6("rms", 5).alias("rms"),
    )


@query(
    """WITH t AS (SELECT s_nationkey AS nation, s_suppkey AS track, s_acctbal - floor(s_acctbal / 80) * 80 AS x, (s_suppkey * 37 % 60)::DOUBLE AS y FROM supplier),
c AS (SELECT c_nationkey AS nation, c_custkey AS id, c_acctbal - floor(c_acctbal / 80) * 80 AS ax, (c_custkey % 60)::DOUBLE AS ay, 4 + (c_custkey % 17)::DOUBLE AS measured, 0.4 + (c_custkey % 5) / 10 AS sigma FROM customer),
p AS (SELECT id, track, abs(sqrt((x - ax)^2 + (y - ay)^2 + 1) - measured) / sigma AS off FROM c JOIN t USING (nation)),
b AS (SELECT id, track, off FROM p WHERE off <= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY off, track) = 1)
SELECT c.id, b.track, round(off, 6) AS off FROM c LEFT JOIN b USING (id)"""
)
def range_associate(spark, sf_dir):
    """The track that each measured range is most likely about, within three deviations."""
    tables = Tables(spark, sf_dir)
    wrapped = lambda c: F.col(c) - F.floor(F.col(c) / 80) * 80
    tracks = tables.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("track"), wrapped("s_acctbal").alias("x"), (F.col("s_suppkey") * 37 % 60).cast("double").alias("y"), F.lit(1.0).alias("z"))
    ranges = tables.customer.select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), wrapped("c_acctbal").alias("ax"), (F.col("c_custkey") % 60).cast("double").alias("ay"), F.lit(0.0).alias("az"),
        (4 + F.col("c_custkey") % 17).cast("double").alias("measured"), (0.4 + F.col("c_custkey") % 5 / 10).alias("sigma"),
    )
    return ranging.associate(ranges, tracks, ["nation"], "id", "track").select("id", "track", r6("off").alias("off"))
