"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The
Manhattan distance of two such vectors never exceeds the Hamming distance, so it is a
lower bound. The segments fall into three groups; fingerprints that differ in at most
``3 * 1 + 1 = 4`` bits are within Manhattan distance 1 in at least one group. A grid over
each group's counts finds these: a vector of even sum is entered in its own cell, one of
odd sum in its own and in every cell at distance 1 (distance 1 flips the parity, so
each such pair meets). Candidates are filtered by the whole Manhattan distance and
verified by the exact Hamming distance. No link is lost.

Equal fingerprints are collapsed before the search, and a cell of any size is searched
in blocks, so neither copies nor a crowded cell reach one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.base import keep_smallest, keeps_names, Links, neighbours, text_batches, text_hash, units, whole_units
from rippleframe.llm.components import components
from rippleframe.session import durable

SHINGLE = 4
MAX_BITS = 4
SEED = 42
GROUPS = (range(0, 11), range(11, 22), range(22, 32))
CELL_ROWS = 2048
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def shingle_digests(text: str | None, shingle: int) -> tuple[bytes, bytes]:
    """The lower-cased words of a text joined by spaces, and the 8-byte digests of its shingles; both empty for a blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return b"", b""
    line = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = min(shingle, len(words))
    first, last = np.append(0, stop[:-n] + 1).tolist(), stop[n - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return line, b"".join([digest(line[i:j], SEED) for i, j in zip(first, last)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 for null, empty and blank texts."""
    _, digests = shingle_digests(text, shingle)
    if not digests:
        return 0
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
    count, whole = np.zeros(64, dtype=np.int64), len(bits) // 255
    if whole:  # sums of 255 bits fit a byte
        count += bits[: whole * 255].reshape(whole, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    count += bits[whole * 255 :].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a long) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = text_batches(docs).select("doc_id", text_hash("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def thermometer(fp: np.ndarray) -> np.ndarray:
    """Two-bit counts in unary: the popcount of a difference is then the Manhattan distance."""
    high = fp >> _ONE
    return ((fp | high) & _ODD) | ((fp & high & _ODD) << _ONE)


def grid_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index) entries of unsigned fingerprints."""
    counts = (fp & _ODD) + ((fp >> _ONE) & _ODD)
    digit = ((counts[:, None] >> (np.arange(32, dtype=np.uint64) * np.uint64(2))) & np.uint64(3)).astype(np.int64)
    cells, index, base = [], [], 0
    for group in GROUPS:
        own = digit[:, list(group)]
        power = 3 ** np.arange(len(group), dtype=np.int64)
        code = own @ power + base
        cells.append(code)
        index.append(np.arange(len(fp)))
        odd = np.flatnonzero(own.sum(1) % 2)
        for step in (1, -1):
            row, col = np.nonzero((own[odd] + step >= 0) & (own[odd] + step <= 2))
            cells.append(code[odd[row]] + step * power[col])
            index.append(odd[row])
        base += 3 ** len(group)
    return np.concatenate(cells), np.concatenate(index)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        cell, index = grid_cells(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[index])], names=["cell", "fp"])


def _linker(max_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, unit in whole_units(batches, ["cell", "__i", "__j"]):
            signed = table.column("fp").to_numpy()
            fp = signed.view(np.uint64)
            unary, links = thermometer(fp), Links()
            for i, j in neighbours(unit):
                near = np.bitwise_count(unary[i] ^ unary[j]) <= max_bits
                i, j = i[near], j[near]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                links.add(signed[i[near]], signed[j[near]])
            a, b = links.stars()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def link_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits.

    ``max_bits`` up to 5 is exact: three groups at distance 1 cover it.
    """
    if max_bits > 2 * len(GROUPS) - 1:
        raise ValueError("the grid covers at most 5 differing bits")
    cells = durable(distinct.mapInArrow(_entries, "cell bigint, fp bigint"), "cells")
    return units(cells, "cell", "fp", CELL_ROWS).mapInArrow(_linker(max_bits), "a bigint, b bigint")


def rooted(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fp, root (the same for all rows of a component) and component_id of every row."""
    stored = durable(fingerprints(docs, shingle), "fingerprints")
    distinct = durable(stored.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(link_fingerprints(distinct.select("fp"), max_bits))
    own = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = own.groupBy("root").agg(F.min("low").alias("component_id"))
    per_fp = own.join(smallest, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    return stored.join(per_fp, stored["fp"] == per_fp["__fp"]).drop("__fp")


def classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every document row.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. A row
    with a null doc_id takes part; component_id is null only if all ids of the component
    are. Repeated rows are each returned. An empty table gives an empty result.
    """
    return rooted(docs, shingle, max_bits).select("doc_id", "fp", "component_id")


@keeps_names
def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id, then text hash.

    Rows are told apart by doc_id and text together; of rows that agree in both one
    stays. A null doc_id is the largest.
    """
    return keep_smallest(docs, rooted(docs, shingle, max_bits))
