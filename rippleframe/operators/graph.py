"""A directed property graph as node and edge tables.

Nodes are ``id, kind, ord``; edges are ``src, dst, rel, ord``. ``ord`` is the
insertion order. Every lookup is an equi-join of edges with nodes, whose ids are
unique, so a hot node never multiplies rows; AQE splits its partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def neighbors(self) -> DataFrame:
        """Outgoing edges with the kind of their target."""
        target = self.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
        return self.edges.join(target, "dst").select("src", "dst", "rel", "dst_kind")

    def contents_of(self) -> DataFrame:
        """(container, member) for every ``located_in`` edge of a known container."""
        inside = self.edges.filter("rel = 'located_in'").select(F.col("dst").alias("container"), F.col("src").alias("member"))
        return inside.join(self.nodes.select(F.col("id").alias("container")), "container", "left_semi")

    def observed_by(self) -> DataFrame:
        return self.edges.filter("rel = 'observes'").select(F.col("src").alias("sensor"), F.col("dst").alias("target"))

    def room_for_area(self, area: str) -> DataFrame:
        """First inserted room of each area."""
        rooms = self.nodes.filter(F.col("kind") == "room")
        return rooms.groupBy(area).agg(F.min_by("id", "ord").alias("room"))

    def remove(self, gone: DataFrame) -> Graph:
        """Drop the nodes in ``gone`` (column ``id``) and all their edges."""
        ids = gone.select("id").distinct()
        nodes = self.nodes.join(ids, "id", "left_anti")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
        edges = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(nodes, edges.select(self.edges.columns))

    def upsert(self, incoming: DataFrame) -> Graph:
        """Replace nodes by id; replaced nodes keep their insertion order."""
        values = [c for c in self.nodes.columns if c not in ("id", "ord")]
        old = self.nodes.select("id", "ord", F.lit(0).alias("_v"), F.struct(*values).alias("_n"))
        new = incoming.select("id", "ord", F.lit(1).alias("_v"), F.struct(*values).alias("_n"))
        merged = old.unionByName(new).groupBy("id").agg(F.min("ord").alias("ord"), F.max_by("_n", F.struct("_v", "ord")).alias("_n"))
        return Graph(merged.select("id", *[f"_n.{c}" for c in values], "ord").select(self.nodes.columns), self.edges)

    def add_edges(self, new: DataFrame) -> tuple[Graph, DataFrame]:
        """Append edges whose ends exist; the second result holds the refused ones."""
        ids = self.nodes.select("id")
        ok = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        ok = ok.select(self.edges.columns)
        known = new.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left")
        known = known.join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
        refused = known.filter("_s IS NULL OR _d IS NULL").select(self.edges.columns)
        return Graph(self.nodes, self.edges.unionByName(ok)), refused

    def evidence(self, states: DataFrame) -> DataFrame:
        """``derived_from`` edges for semantic states with ``sources`` and ``evidence`` arrays.

        Evidence is paired by position; unknown sources are skipped.
        """
        rows = states.select("id", "evidence", F.posexplode("sources").alias("i", "dst"))
        rows = rows.join(self.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        return rows.select(F.col("id").alias("src"), "dst", F.lit("derived_from").alias("rel"), F.coalesce(F.get("evidence", F.col("i")), F.lit("")).alias("evidence"))

    def decisions(self, allowed: Column) -> DataFrame:
        """One decision per ``observes`` edge; ``allowed`` sees ``src_kind`` and ``dst_kind``."""
        e = self.edges.filter("rel = 'observes'")
        e = e.join(self.nodes.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src")
        e = e.join(self.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
        return e.select("src", "dst", "src_kind", "dst_kind", allowed.alias("allowed"))

    def privacy_rollup(self, allowed: Column) -> DataFrame:
        """Decisions counted per sensor, with the number of suppressed targets.

        Targets are reduced to distinct (sensor, target, decision) first, so the
        distinct count is a plain count afterwards.
        """
        d = self.decisions(allowed).groupBy("src", "dst", "allowed").agg(F.count(F.lit(1)).alias("n"))
        return d.groupBy(F.col("src").alias("sensor")).agg(
            F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("allowed_pairs"),
            F.sum(F.when(~F.col("allowed"), F.col("n")).otherwise(0)).alias("denied_pairs"),
            F.count_if(~F.col("allowed")).alias("suppressed"),
        )

    def snapshot(self) -> DataFrame:
        """Nodes and edges as sorted-key JSON lines in insertion order columns."""
        n = self.nodes.select(F.lit("node").alias("part"), "ord", F.to_json(F.struct(*sorted(c for c in self.nodes.columns if c != "ord"))).alias("json"))
        e = self.edges.select(F.lit("edge").alias("part"), "ord", F.to_json(F.struct(*sorted(c for c in self.edges.columns if c != "ord"))).alias("json"))
        return n.unionByName(e)
