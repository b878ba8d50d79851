"""Structured Streaming runners for the stateful updates.

State lives in RocksDB and each micro-batch is bounded by the source's admission
settings, so memory does not grow with a key's history. Rows of a key are put into
event order within the micro-batch; a micro-batch that goes back behind an earlier one
fails with a message, because its result would depend on the order of files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rippleframe.session import checkpoint_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a key that an update sees at once.
SLICE_ROWS = 32_768


def _are_vectors(column: pd.Series) -> bool:
    """Whether a column holds number arrays of one length and none is null."""
    if column.dtype != object or not len(column) or not all(isinstance(v, np.ndarray) for v in column):
        return False
    return len({len(v) for v in column}) == 1 and all(v.dtype == np.float64 for v in column)


def _order(batch: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Places of the rows in the order of ``columns``."""
    if all(batch[c].dtype.kind in "iuf" for c in columns):
        return np.lexsort([batch[c].to_numpy() for c in reversed(columns)])
    return batch[columns].reset_index(drop=True).sort_values(columns).index.to_numpy()


class UpdateProcessor(StatefulProcessor):
    """Applies an update to the rows of a key in a micro-batch, with one typed state value per key."""

    def __init__(self, update: Callable, state: str, order: Sequence[str], columns: Sequence[str], key_columns: Sequence[str]):
        self._update, self._state, self._order = update, state, list(order)
        self._columns, self._key = list(columns), list(key_columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("state", self._state)
        self._last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts, vectors = [], {}
        for part in rows:
            for name in [c for c in part.columns if _are_vectors(part[c])]:
                vectors.setdefault(name, {})[len(parts)] = np.stack(part.pop(name).to_numpy())
            parts.append(part)
        # A column of equal vectors is one matrix; where only some parts are such, all become lists again.
        for name in list(vectors):
            if len(vectors[name]) < len(parts) or len({m.shape[1] for m in vectors[name].values()}) > 1:
                for k, m in vectors.pop(name).items():
                    parts[k][name] = list(m)
        vectors = {name: np.concatenate([by_part[k] for k in range(len(parts))]) for name, by_part in vectors.items()}
        batch = pd.concat(parts, ignore_index=True)
        del parts
        batch = batch.iloc[_order(batch, self._order)]
        at = batch.index.to_numpy()
        first, last = int(batch[self._order[0]].iloc[0]), int(batch[self._order[0]].iloc[-1])
        before, state = self._last.get(), self._value.get()  # None at first; each call goes to the JVM and back
        if before is not None and first < before[0]:
            raise ValueError(f"key {key}: {self._order[0]} {first} comes after {before[0]}; feed files in event order")
        state = None if state is None else tuple(state)
        # The update sees a bounded number of rows, as if they came in several micro-batches.
        for start in range(0, len(batch), SLICE_ROWS):
            some = batch.iloc[start : start + SLICE_ROWS].reset_index(drop=True)
            for name, matrix in vectors.items():
                some[name] = list(matrix[at[start : start + SLICE_ROWS]])
            state, out = self._update(state, some)
            yield pd.DataFrame({**dict(zip(self._key, key)), **{c: out[c] for c in self._columns}}, index=out.index)
        self._value.update(state)
        self._last.update((last,))

    def close(self) -> None:
        pass


def apply_update(stream: DataFrame, key: Sequence[str], update: Callable, state: str, order: Sequence[str], schema: str) -> DataFrame:
    """Stateful columns for a stream; ``schema`` lists the key columns first, ``order`` starts with a whole number."""
    from pyspark.sql import types as T

    names = T._parse_datatype_string(schema).fieldNames()
    processor = UpdateProcessor(update, state, order, names[len(key) :], key)
    return stream.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "None")


def read_stream(spark: SparkSession, folder: str, name: str, max_bytes: int = 256 << 20) -> DataFrame:
    """One Parquet table (a file or a folder of files) as a stream, about ``max_bytes`` per micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern, because a stream takes a plain path for a folder.
    pattern = f"{folder}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(pattern)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there, write it to the shared folder, and read it back.

    The sink is exactly-once with its checkpoint next to it.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def updates_sink(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]]):
    """One stream to several named handlers, each called once per micro-batch."""

    def dispatch(batch: DataFrame, epoch: int) -> None:
        for handle in handlers.values():
            handle(batch, epoch)

    return stream.writeStream.foreachBatch(dispatch)
