"""Best-fit packing after Martello-Toth dominance reduction.

Spark tokenises, cuts and numbers the pieces; the packing itself needs only how many
pieces there are of each length, a table of at most ``capacity`` rows whatever the size
of the corpus. On it the reduction fixes pairs that no other filling can beat, and
best fit decreasing packs the rest, many equal sequences at a time. The plan says for
each length which ranks go to which sequences; its size depends on the capacity alone,
so it is broadcast, and each piece finds its place by its rank among equal lengths.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rippleframe.llm.base import lean, text_batches
from rippleframe.session import durable

CAPACITY = 2048
END = 0
#: Pieces of text that the tokenizer's pre-tokenizer keeps apart (fixed value, from its file).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts with anything else (marks that compose, odd spaces, special tokens) are encoded whole.
PLAIN = regex.compile(r"[\x00-\x1b\x20-\x7f\xa1-įı-ɏ]*")
CACHE = 300_000


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a bounded cache of words.

    For plain texts the tokenizer's result is that of its white-space separated words, so
    each distinct word is encoded once; equality with encoding the whole text is tested.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def word(self, word: str) -> bytes:
        ids = []
        for piece in PIECES.findall(word):
            level = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids += [t.id for t in self.model.tokenize(level)]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.lower().split()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return b"".join(map(known.__getitem__, words))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker; functions and their globals arrive anew with each task."""
    return vars(sys.modules.setdefault("_rippleframe_worker", types.ModuleType("_rippleframe_worker"))).setdefault("cache", {})


def _pieces(path: str, capacity: int):
    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        encoder = cache.get(path) or cache.setdefault(path, Encoder(path))
        end, task, seen, size = np.array([END], dtype="<u4").tobytes(), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64), 4 * capacity
        for batch in batches:
            row, piece, length, crc, rank = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for p, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    n = len(part) // 4
                    row.append(k), piece.append(p), length.append(n), crc.append(zlib.crc32(part)), rank.append(int(seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int64()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "__task", "__rank"],
            )
        encoder.known.clear()  # the worker goes on to other tasks; only the tokenizer is kept

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document row, ranked among equal lengths of their task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, __task bigint, __rank bigint"
    return text_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, capacity), schema)


def _largest(count: np.ndarray, most: int) -> int:
    """The largest length up to ``most`` that is left, or 0."""
    left = np.flatnonzero(count[: max(most, 0) + 1])
    return int(left[-1]) if len(left) and left[-1] > 0 else 0


def _smallest(count: np.ndarray, n: int) -> list[int]:
    """The ``n`` smallest lengths left, repeats counted."""
    out: list[int] = []
    for length in np.flatnonzero(count)[:n].tolist():
        out += [length] * min(int(count[length]), n - len(out))
    return out


def reduce_instance(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, as (lengths of one sequence, number of such sequences); ``count`` keeps the rest.

    With k the largest length that fits beside j, the set {j, k} dominates every filling
    that holds j if j + k fills the sequence, if no two further lengths fit beside j, or
    if at most two fit and no fitting two are together longer than k. If nothing fits
    beside j, {j} dominates. Passes repeat until none fixes a set.
    """
    fixed, changed = [], True
    while changed:
        changed = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                count[j] -= 1  # one j is placed; what else is left beside it?
                room = capacity - j
                k, low = _largest(count, room), _smallest(count, 3)
                count[j] += 1
                if not k:
                    pattern, times = (j,), int(count[j])
                elif j + k == capacity or len(low) < 2 or low[0] + low[1] > room or ((len(low) < 3 or sum(low) > room) and _best_two(count, j, room) <= k):
                    # Taking lengths away only removes alternatives, so this holds until j or k runs out.
                    pattern, times = (j, k), int(count[j] // 2 if j == k else min(count[j], count[k]))
                else:
                    break
                for length in pattern:
                    count[length] -= times
                fixed.append((pattern, times))
                changed = True
    return fixed


def _best_two(count: np.ndarray, j: int, room: int) -> int:
    """The largest sum up to ``room`` of two lengths left beside one j, or 0."""
    have = count.copy()
    have[j] -= 1
    best, lengths = 0, np.flatnonzero(have[: room + 1])
    for a in lengths.tolist():
        have[a] -= 1
        b = _largest(have, room - a)
        have[a] += 1
        best = max(best, a + b if b else 0)
    return best


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: (lengths of one sequence, number of such sequences)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(count)[::-1].tolist():
        left = int(count[length])
        for room in sorted(r for r in open_ if r >= length):
            # Sequences of the tightest room first; each takes as many of this length as fit.
            groups, fit = open_.pop(room), room // length
            rest = []
            for pattern, n in groups:
                full = min(n, left // fit)
                if full:
                    open_.setdefault(room - fit * length, []).append((pattern + (length,) * fit, full))
                    left, n = left - full * fit, n - full
                if n and left:
                    open_.setdefault(room - left * length, []).append((pattern + (length,) * left, 1))
                    left, n = 0, n - 1
                if n:
                    rest.append((pattern, n))
            if rest:
                open_.setdefault(room, []).extend(rest)
            if not left:
                break
        fit = capacity // length
        if left // fit:
            open_.setdefault(capacity - fit * length, []).append(((length,) * fit, left // fit))
        if left % fit:
            open_.setdefault(capacity - (left % fit) * length, []).append(((length,) * (left % fit), 1))
    return [group for groups in open_.values() for group in groups]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces of the length in a sequence, offset of the first) rows."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] = n
    groups = reduce_instance(count, capacity) + best_fit(count, capacity)
    used, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for pattern, n in groups:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length, used[length], n * each, sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document row with their sequence and offset; ``path`` is the tokenizer's file.

    Null and empty texts are one piece holding the end token alone. Repeated rows are
    packed as often as they occur, null ids like others; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    pieces = durable(token_pieces(docs, path, capacity), "pieces")
    tally = durable(pieces.groupBy("__task", "length").agg(F.count(F.lit(1)).alias("n")), "tally")
    earlier = W.partitionBy("length").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)  # a row per task and length
    base = tally.select(F.col("__task").alias("__t"), F.col("length").alias("__l"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = plan_sequences(histogram, capacity)
    table = spark.createDataFrame(rows, "__len bigint, __from bigint, __ranks bigint, __seq bigint, __each bigint, __offset bigint")
    # The plan lists sets of lengths, so its size depends on the capacity and not on the corpus.
    ranked = pieces.join(base, (F.col("__task") == F.col("__t")) & (F.col("length") == F.col("__l")))
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__base")).drop("__task", "__t", "__l", "__base")
    slots = table.withColumn("__until", F.col("__from") + F.col("__ranks"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__until")))
    at = F.col("__rank") - F.col("__from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("__seq") + F.floor(at / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + F.pmod(at, F.col("__each")) * F.col("length")).cast("long").alias("offset"),
    )
