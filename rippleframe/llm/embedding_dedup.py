"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and quantised; ``BITS``
such numbers name a bucket, and each of ``TABLES`` tables has its own. Cosine 0.98 is a
distance of 0.2, at which two vectors share a bucket in some table with probability over
0.999. Exact cosine checks inside the buckets give links, of which only a spanning set
leaves a task; links inside each connected component are then counted exactly, so a
pair that no bucket held is still counted when its component was found.

Equal vectors of a label are collapsed first, and crowded buckets or components are
searched in blocks, so no group is held or emitted whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.base import Links, finite, matrix, neighbours, units, whole_units
from rippleframe.llm.components import components
from rippleframe.session import durable

MIN_COSINE = 0.98
TABLES, NUMBERS, WIDTH = 32, 10, 1.2
SEED = 42
BLOCK_ROWS = 1024


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def buckets(vectors: np.ndarray, tables: int = TABLES, numbers: int = NUMBERS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """A (rows, tables) array of bucket hashes of unit vectors."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    direction = rng.standard_normal((vectors.shape[1], tables * numbers))
    shift = rng.uniform(0, width, tables * numbers)
    cell = np.floor((vectors @ direction + shift) / width).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, numbers)
    mixed = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), cell.shape[:2])
    for k in range(numbers):
        mixed = (mixed ^ cell[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = mixed ^ (mixed >> np.uint64(29))
    return mixed.view(np.int64)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.diff(batch.column(1).offsets.to_numpy())
        for width in np.unique(size):  # vectors of different lengths never link
            at = np.flatnonzero(size == width)
            keys = buckets(unit_vectors(matrix(batch.column(1).take(pa.array(at)))))
            cid = np.repeat(batch.column(0).to_numpy()[at], keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cid)], names=["bucket", "cid"])


def _close(table: pa.Table, unit: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a unit's rows that agree in label and length and have the cosine."""
    size = table.column("size").to_numpy()
    label = table.column("label").to_numpy()
    vectors = unit_vectors(matrix(table.column("v")))
    for i, j in neighbours(unit):
        same = (label[i] == label[j]) & (size[i] == size[j])
        i, j = i[same], j[same]
        near = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= min_cosine
        yield i[near], j[near]


def _linker(min_cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, unit in whole_units(batches, ["bucket", "__i", "__j"]):
            cid, links = table.column("cid").to_numpy(), Links()
            for i, j in _close(table, unit, min_cosine):
                links.add(cid[i], cid[j])
            a, b = links.stars()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _degrees(min_cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, unit in whole_units(batches, ["root", "__i", "__j"]):
            cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
            home, across = table.column("__home").to_numpy(), table.column("__i").to_numpy() != table.column("__j").to_numpy()
            degree = np.zeros(len(cid), dtype=np.int64)
            for i, j in _close(table, unit, min_cosine):
                once = ~across[i] | (home[i] != home[j])  # rows of one block are compared in its own unit only
                i, j = i[once], j[once]
                np.add.at(degree, i, copies[j])
                np.add.at(degree, j, copies[i])
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(degree)], names=["cid", "degree"])

    return run


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Two rows link if their labels are equal and not null and their cosine reaches
    ``min_cosine``. ``n_links`` counts other rows linked directly, ``component_id`` is the
    smallest vec_id reachable, ``kept`` marks rows whose own id that is. Vectors that are
    null, empty, zero or hold null or non-finite numbers, and rows without a label, link
    with nothing. Vectors of different lengths do not link. Repeated rows count as
    separate vectors; a null vec_id takes part, is never the smallest, and is not kept.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    good = finite("v") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = rows.withColumn("good", good).withColumn("label", F.xxhash64(F.col("label").cast("string")))
    classes = rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "vectors")
    entries = durable(classes.select("cid", "v").mapInArrow(_entries, "bucket bigint, cid bigint"), "buckets")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").alias("b"))
    met = entries.join(shared, entries["bucket"] == shared["b"], "left_semi").withColumnRenamed("cid", "c")
    met = durable(met.join(classes, met["c"] == classes["cid"]).select("bucket", "cid", "label", "size", "v"), "candidates")
    links = units(met, "bucket", "cid", BLOCK_ROWS).mapInArrow(_linker(min_cosine), "a bigint, b bigint")
    roots = durable(components(links), "roots")
    grouped = roots.union(roots.select("root", "root")).distinct()  # every member of a component of two or more
    members = grouped.join(classes, grouped["node"] == classes["cid"])
    members = durable(members.select("root", "cid", "label", "size", "v", "low", "copies"), "members")
    degree = units(members, "root", "cid", BLOCK_ROWS).mapInArrow(_degrees(min_cosine), "cid bigint, degree bigint")
    degree = degree.groupBy(F.col("cid").alias("d")).agg(F.sum("degree").alias("degree"))
    lowest = members.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component"))
    linked = members.join(degree, members["cid"] == degree["d"]).join(lowest, F.col("root") == F.col("r"))
    linked = linked.select(F.col("cid").alias("c"), "degree", "component")
    found = classes.join(linked, classes["cid"] == linked["c"], "left")
    found = found.select(
        F.col("label").alias("l"), F.col("v").alias("w"),
        (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "low").alias("low"),
    )
    out = rows.where("good").join(found, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")))
    out = out.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("low").alias("component_id"))
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = out.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
