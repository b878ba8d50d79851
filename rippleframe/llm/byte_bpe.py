"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are cut as the usual pattern of rank files cuts them (contractions, runs of letters, of
numbers and of other signs with one space before them, white space), but without a regular
expression: code points are mapped to classes by a table, a class and its neighbours give a
symbol, and a small automaton over the symbols says where a piece starts. Symbols are
transition functions; these form a finite monoid, so a batch of texts is scanned as an
associative prefix operation over elements of one byte, many blocks at a time. The first
symbol of a text is a constant function, so no state passes from one text to the next.

Pieces are slices of the UTF-8 bytes; each distinct piece is merged once per worker and kept in a
bounded cache. An encoded row keeps the byte offset of every token, and decoding places
the tokens' bytes at these offsets.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.base import text_batches
from rippleframe.llm.packing import worker_cache

#: Pieces kept by a worker, and the longest piece that is kept, in bytes.
CACHE, CACHE_BYTES = 300_000, 64
#: Bytes of text handled at once; work arrays take a multiple of it.
SLICE_BYTES = 1 << 20
#: Longer pieces, in bytes, are merged with a queue, in time that stays almost linear.
SHORT_PIECE = 128
#: Columns of a block scan.
BLOCK = 256

LETTER, NUMBER, OTHER, BLANK = range(4)
#: Symbols: the first three are the classes; an apostrophe before one or two letters of a contraction;
#: the last white space before something else, a plain space or not; any other white space.
SHORT, LONG, SPACE, LAST, WHITE = 3, 4, 5, 6, 7
SYMBOLS = 8
#: States: what the piece holds to which the last code point belongs. JOIN: a space that joins what
#: follows; ONE and TWO: a contraction that lacks so many letters; DONE: a whole contraction.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOIN, IN_WHITE, ONE, TWO, DONE = range(9)
STATES = 9
#: Letters of contractions after the apostrophe (fixed values, from the pattern).
CONTRACTED = ("s", "t", "m", "d"), ("re", "ve", "ll")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) by state and symbol."""
    after = np.empty((STATES, SYMBOLS), dtype=np.uint8)
    starts = np.ones((STATES, SYMBOLS), dtype=bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, ONE), (LONG, TWO), (SPACE, JOIN), (LAST, IN_WHITE), (WHITE, IN_WHITE)):
        after[:, symbol] = state
    for state, symbol in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHERS, OTHER), (IN_WHITE, WHITE), (JOIN, LETTER), (JOIN, NUMBER), (JOIN, OTHER)):
        starts[state, symbol] = False
    for state in (IN_OTHERS, JOIN):  # here an apostrophe is one of the other signs
        after[state, [SHORT, LONG]] = IN_OTHERS
        starts[state, [SHORT, LONG]] = False
    after[TWO, LETTER], after[ONE, LETTER] = ONE, DONE
    starts[[ONE, TWO], LETTER] = False
    return after, starts


def _monoid(after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, flat table of products, state reached from BEGIN) of the transition functions.

    Symbol ``s + SYMBOLS`` is symbol ``s`` at the start of a text: it forgets the state before.
    """
    generators = [tuple(after[:, s]) for s in range(SYMBOLS)] + [(after[BEGIN, s],) * STATES for s in range(SYMBOLS)]
    found = {tuple(range(STATES)): 0}
    queue = list(found)
    for f in queue:
        for g in generators:
            if (h := tuple(g[x] for x in f)) not in found:
                found[h] = len(found)
                queue.append(h)
    all_functions = np.array(queue, dtype=np.uint8)
    products = [[found[tuple(g[f])] for g in all_functions] for f in all_functions]
    table = np.zeros((16, 16), dtype=np.uint8)  # a pair of elements fits a byte
    table[: len(queue), : len(queue)] = products
    return np.array([found[g] for g in generators], dtype=np.uint8), table.ravel(), all_functions[:, BEGIN].copy()


AFTER, STARTS = _automaton()
ELEMENT, PRODUCT, REACHED = _monoid(AFTER)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return PRODUCT.take(a << np.uint8(4) | b)


def scan(elements: np.ndarray) -> np.ndarray:
    """Inclusive prefix products: blocks side by side, then the blocks' totals, then both together."""
    n = len(elements)
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, dtype=np.uint8)  # element 0 is the identity
    padded[:n] = elements
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    for k in range(1, BLOCK):
        grid[k] = _times(grid[k - 1], grid[k])
    if rows > 1:
        before = np.zeros(rows, dtype=np.uint8)
        before[1:] = scan(grid[-1])[:-1]
        grid = _times(np.broadcast_to(before, grid.shape), grid)
    return grid.T.ravel()[:n]


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """(first code point, class) of each run of equal classes, as the tiktoken library sees them.

    The library is asked for the letters, numbers and white space among all code points, so
    both follow one version of Unicode.
    """
    import tiktoken

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        every = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(every.encode_ordinary(text)).decode().encode("utf-32-le"), dtype="<u4")] = kind
    first = np.flatnonzero(np.append(True, table[1:] != table[:-1]))
    return first, table[first]


def class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    first, kind = runs
    return np.repeat(kind, np.diff(np.append(first, 0x110000)))


def piece_starts(points: np.ndarray, text_starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point of texts laid end to end; ``text_starts`` are those of non-empty texts."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=bool)
    first = np.zeros(n + 2, dtype=bool)
    first[text_starts] = True
    first[n:] = True
    kind = table[points]
    symbol = kind.copy()
    blank = kind == BLANK
    # Something that is no white space follows in the same text.
    last = blank & ~first[1 : n + 1] & ~np.append(blank[1:], True)
    symbol[blank] = WHITE
    symbol[last] = np.where(points[last] == 32, SPACE, LAST)
    mark = np.flatnonzero((points == 39) & ~first[1 : n + 1])
    one, two = points[mark + 1], points[np.minimum(mark + 2, n - 1)]
    symbol[mark[np.isin(one, [ord(c) for c in CONTRACTED[0]])]] = SHORT
    both = np.zeros(len(mark), dtype=bool)
    for a, b in CONTRACTED[1]:
        both |= (one == ord(a)) & (two == ord(b))
    symbol[mark[both & ~first[mark + 2]]] = LONG
    state = REACHED[scan(ELEMENT[symbol + first[:n] * np.uint8(SYMBOLS)])]
    before = np.append(np.uint8(BEGIN), state[:-1])
    before[first[:n]] = BEGIN
    return STARTS[before, symbol]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the pair of lowest rank is joined first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    return _merge_short(piece, ranks) if n <= SHORT_PIECE else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    none, get = len(ranks) << 8, ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[part] for part in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is gone
    left = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has been joined to another since
        end[i], end[middle] = stop, 0
        if stop < n:
            left[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(queue, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, number) of rows whose ``sizes`` add up to about SLICE_BYTES; a larger row stands alone."""
    end, start = np.cumsum(sizes), 0
    while start < len(end):
        past = (end[start - 1] if start else 0) + SLICE_BYTES
        stop = max(start + 1, int(np.searchsorted(end, past, side="right")))
        yield start, stop - start
        start = stop


class Vocabulary:
    """The bytes of every id of a file and, with ``runs``, its ranks and the pieces merged so far."""

    def __init__(self, path: str, runs: tuple[np.ndarray, np.ndarray] | None = None):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        self.table = None if runs is None else class_table(runs)
        by_id = {i: token for token, i in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.length = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.ranks = {} if runs is None else ranks  # decoding needs none
        self.known: dict[bytes, bytes] = {}

    def _ids(self, piece: bytes) -> bytes:
        return np.array(merge(piece, self.ranks), dtype="<i4").tobytes()

    def encode(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids up to the end of each text) of texts that end at ``ends`` in ``raw``."""
        points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4")
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
        at = np.cumsum(width) - width
        begins = np.append(0, ends[:-1])
        starts = at[piece_starts(points, np.searchsorted(at, begins[ends > begins]), self.table)]
        bounds = np.append(starts, len(raw)).tolist()
        pieces = [raw[i:j] for i, j in zip(bounds, bounds[1:])]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = set(pieces).difference(known)
        for piece in new:
            known[piece] = self._ids(piece)
        found = list(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > CACHE_BYTES:
                del known[piece]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        upto = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, ends)]
        return np.frombuffer(b"".join(found), dtype="<i4"), upto

    def decode(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bytes of tokens that are placed at the offsets ``at``, without gaps."""
        length = self.length[ids]
        total = int(at[-1] + length[-1]) if len(ids) else 0
        place = np.repeat(self.start[ids] - at, length)
        place += np.arange(total)
        return self.bytes[place]


def _vocabulary(path: str, runs: tuple[np.ndarray, np.ndarray] | None) -> Vocabulary:
    cache, key = worker_cache(), ("byte_bpe", path, runs is None)
    return cache.get(key) or cache.setdefault(key, Vocabulary(path, runs))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ids (array of int) and at (array of int: the byte offset of each token in its text) of every row.

    Ids are those of the rank file at ``path``, a path that all executors can read, without
    special tokens: their strings are ordinary text. Null and empty texts have no ids.
    Whole texts are encoded, whatever their length; repeated rows are each returned. Other
    columns of ``docs`` are not carried, whatever their names. An empty table gives an
    empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, runs)
        for batch in batches:
            for start, rows in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
                part = batch.slice(start, rows)
                raw = [v or b"" for v in part.column(1).cast(pa.binary()).to_pylist()]
                ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=rows))
                ids, upto = vocabulary.encode(b"".join(raw), ends)
                length = vocabulary.length[ids]
                in_text = np.repeat(np.append(0, ends[:-1]), np.diff(upto, prepend=0))
                offsets = pa.array(np.append(0, upto), pa.int32())
                own = (np.cumsum(length) - length - in_text).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(own))], names=["k", "ids", "at"])

    runs = class_runs()
    rows = text_batches(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, ids array<int>, at array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """The key, ids and decoded (binary: the bytes of the ids, placed at their offsets) of every row of ``encoded``.

    Null ids count as none. Ids that the rank file lacks fail with an IndexError.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, None)
        for batch in batches:
            counts = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            length = vocabulary.length[batch.column(1).flatten().to_numpy(zero_copy_only=False)]
            whole = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(counts))]
            for start, rows in slices(np.diff(whole)):
                part, sizes = batch.slice(start, rows), counts[start : start + rows]
                ids = part.column(1).flatten().to_numpy(zero_copy_only=False)
                at = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                spelled = whole[start : start + rows + 1] - whole[start]
                out = vocabulary.decode(ids, at + np.repeat(spelled[:-1], sizes))
                binary = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(spelled.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binary], names=["k", "ids", "decoded"])

    rows = text_batches(encoded).select(F.col(key).alias("k"), "ids", "at")
    return rows.mapInArrow(run, f"k {encoded.schema[key].dataType.simpleString()}, ids array<int>, decoded binary").withColumnRenamed("k", key)
