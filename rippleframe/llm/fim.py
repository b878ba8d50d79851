"""Fill-in-middle transformation as a pipeline of Arrow compute functions.

A text is cut into units: runs of ASCII letters, and every other code point by itself. Per
batch the units of all texts are one list array; it is flattened with the parent index
of every unit, ordinals follow from the parents' offsets, a unit's role (prefix, middle,
suffix) from its ordinal and the two cuts, and the units of each role are rebuilt to lists
and joined. No text is touched by a Python loop.

The order of the pieces is reversible: a text that holds one of the marks stays plain, so the
first mark of each kind in an output is the one that was put there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleframe.llm.base import text_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts so many stay plain, and of 100 others so many put the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20
SEED = "1"
#: Bytes of text worked on at once.
SLICE_BYTES = 4_000_000
_UNIT = rb"[A-Za-z]+|[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*"
#: A byte that no UTF-8 text holds ends each unit.
_END = b"\xff"
_ADDED = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}


def draws(key: Column, seed: str = SEED) -> Column:
    """Four numbers of 32 bits from the SHA-256 of the seed and a row's key; a null key counts as ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])


def _remainder(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(units: pa.Array, keep: pa.Array, counts: pa.Array) -> pa.Array:
    """The kept units of each parent, ``counts`` of them, as one value per parent."""
    ends = pc.cast(pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, units.filter(keep)), pa.scalar(b"", pa.binary()))


def _chars(values: pa.Array) -> pa.Array:
    return pc.cast(pc.utf8_length(pc.cast(values, pa.string())), pa.int64())


def _element(lists: pa.Array, k: int) -> pa.Array:
    return pc.list_element(lists, k)


def _holds_mark(text: pa.Array) -> pa.Array:
    found = [pc.match_substring(text, m.decode()) for m in (PREFIX, SUFFIX, MIDDLE)]
    return pc.or_(pc.or_(found[0], found[1]), found[2])


def arrange(text: pa.Array, h: list[pa.Array], plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> dict[str, pa.Array]:
    """The columns of a transformed batch of texts without nulls; ``h`` are the four draws of each."""
    raw = pc.cast(text, pa.binary())
    lists = pc.split_pattern(pc.replace_substring_regex(raw, pattern=_UNIT, replacement=rb"\0" + _END), pattern=_END)
    sizes = pc.cast(pc.list_value_length(lists), pa.int64())
    # What follows the last end is an empty value, not a unit.
    n = pc.subtract(sizes, 1)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pc.subtract(pc.cumulative_sum(sizes), sizes)
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, parent))
    cuts = [_remainder(x, pc.add(n, 1)) for x in h[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    in_prefix, before_suffix = pc.less(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent))
    in_middle = pc.and_(before_suffix, pc.invert(in_prefix))
    in_suffix = pc.and_(pc.invert(before_suffix), pc.less(ordinal, pc.take(n, parent)))
    prefix = _joined(units, in_prefix, low)
    middle = _joined(units, in_middle, pc.subtract(high, low))
    suffix = _joined(units, in_suffix, pc.subtract(n, high))
    plain = pc.or_(pc.or_(pc.equal(n, 0), _holds_mark(text)), pc.greater_equal(_remainder(h[2], 100), 100 - plain_share))
    spm = pc.less(_remainder(h[3], 100), spm_share)
    mark = [pa.scalar(m, pa.binary()) for m in (PREFIX, SUFFIX, MIDDLE)]
    none = pa.scalar(b"", pa.binary())
    psm_out = pc.binary_join_element_wise(mark[0], prefix, mark[1], suffix, mark[2], middle, none)
    spm_out = pc.binary_join_element_wise(mark[1], suffix, mark[0], prefix, mark[2], middle, none)
    null = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM)),
        "prefix_chars": pc.if_else(plain, null, _chars(prefix)),
        "middle_chars": pc.if_else(plain, null, _chars(middle)),
        "output": pc.cast(pc.if_else(plain, raw, pc.if_else(spm, spm_out, psm_out)), pa.string()),
    }


def rebuild(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that ``arrange`` turned into these outputs, in order."""
    output = pc.cast(output, pa.binary())
    parts, rows = [], []
    for kind, marks in ((PLAIN, ()), (PSM, (PREFIX, SUFFIX, MIDDLE)), (SPM, (SUFFIX, PREFIX, MIDDLE))):
        mask = pc.equal(form, kind)
        own = output.filter(mask)
        rows.append(np.flatnonzero(mask.to_numpy(zero_copy_only=False)))
        if not marks:
            parts.append(own)
            continue
        pieces = []
        for mark in marks:
            halves = pc.split_pattern(own, pattern=mark, max_splits=1)
            pieces.append(_element(halves, 0))
            own = _element(halves, 1)
        _, first, second = pieces
        order = (first, own, second) if kind == PSM else (second, own, first)
        parts.append(pc.binary_join_element_wise(*order, pa.scalar(b"", pa.binary())))
    back = np.argsort(np.concatenate(rows))
    return pc.cast(pc.take(pa.concat_arrays(parts), pa.array(back)), pa.string())


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES each; a longer text stands alone."""
    end = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(end):
        past = (end[start - 1] if start else 0) + SLICE_BYTES
        stop = max(start + 1, int(np.searchsorted(end, past, side="right")))
        yield start, stop - start
        start = stop


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """The key and n, form, prefix_chars, middle_chars and output of every row.

    n counts units, the chars are code points (null if plain). A null text counts as empty;
    empty texts and texts that hold a mark stay plain. The draws depend on the seed and the
    key alone, so repeated rows get equal results and reruns agree; null keys share one
    draw. Other columns of ``docs`` are not carried, whatever their names. A long text
    is cut at no length. An empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _slices(batch.column(1)):
                part = batch.slice(at, rows)
                h = [_element(part.column(2), k) for k in range(4)]
                out = arrange(pc.fill_null(part.column(1), ""), h, plain_share, spm_share)
                yield pa.RecordBatch.from_arrays([part.column(0), *out.values()], names=names)

    names = ["k", *_ADDED]
    rows = text_batches(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), draws(F.col(key), seed).alias("h"))
    schema = {"k": docs.schema[key].dataType.simpleString(), **_ADDED}
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in schema.items())).withColumnRenamed("k", key)


def restore(transformed: DataFrame, key: str = "doc_id") -> DataFrame:
    """All columns of a transformed table and ``restored``, the text before the transformation.

    A null output or form gives a null text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, form = batch.column(names.index("output")), batch.column(names.index("form"))
            known = pc.and_(pc.is_valid(output), pc.is_valid(form))
            text = rebuild(pc.fill_null(output, ""), pc.if_else(known, form, PLAIN))
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(known, text, pa.scalar(None, pa.string()))], names=[*names, "restored"])

    names = transformed.columns
    schema = T.StructType([*transformed.schema.fields, T.StructField("restored", T.StringType())])
    return text_batches(transformed).mapInArrow(run, schema)
