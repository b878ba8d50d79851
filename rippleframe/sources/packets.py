"""Sensor datagrams: one BINARY column in, typed structs and an error column out.

A malformed packet never fails the job; it keeps its bytes and says what is wrong.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleframe.sources import binary as b

# Packet magics and sizes.
RAW_CSI = 0xC5110001
EDGE_VITALS = 0xC5110002
WASM_EVENT = 0xC5110004
SYNC = 0xC511A110
CSI_HEADER = 20
VITALS_SIZE = 32
SYNC_SIZE = 32
WASM_HEADER = 8
WASM_EVENT_SIZE = 5
WASM_MAX_EVENTS = 16


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """One datagram per file, with its path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("content").alias("packet"), F.col("modificationTime").alias("received_at"))


def magic(packet: Column) -> Column:
    return F.when(F.length(packet) >= 4, b.uint(packet, 0, 4))


def band(mhz: Column) -> Column:
    return F.when(mhz >= 5925, "6GHz").when(mhz >= 4900, "5GHz").otherwise("2.4GHz")


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _signed_bytes(data: pa.Array) -> pa.Array:
    """Each byte string as a list of signed values, on the batch's own buffers."""
    data = data.cast(pa.binary())
    start = data.offset
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[start : start + len(data) + 1]
    values = np.frombuffer(data.buffers()[2] or b"", dtype=np.int8)[offsets[0] : offsets[-1]]
    lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(values.astype(np.float64)))
    return pa.compute.if_else(data.is_valid(), lists, pa.scalar(None, lists.type))


def iq(data: Column) -> Column:
    """Interleaved signed bytes as complex structs (real part first)."""
    pairs = F.floor(F.size(data) / 2).cast("int")
    return F.transform(
        F.when(pairs > 0, F.sequence(F.lit(1), pairs)),
        lambda k: F.struct(F.element_at(data, 2 * k - 1).alias("re"), F.element_at(data, 2 * k).alias("im")),
    )


def decode(df: DataFrame, packet: str = "packet") -> DataFrame:
    """Add ``family``, ``error`` and one struct per packet family (null for the others)."""
    p = F.col(packet)
    rows = df.withColumn("_m", magic(p)).withColumn("_n", F.length(p))
    h, n, m = p, F.col("_n"), F.col("_m")
    family = (
        F.when(m == RAW_CSI, "raw_csi").when(m == EDGE_VITALS, "edge_vitals").when(m == WASM_EVENT, "wasm_event").when(m == SYNC, "sync")
    )
    antennas, subcarriers = b.uint(h, 5, 1), b.uint(h, 6, 2)
    pairs = antennas * subcarriers
    events = b.uint(h, 6, 2)
    error = (
        F.when(n < 4, "truncated magic")
        .when(family.isNull(), "unknown magic")
        .when((family == "raw_csi") & (n < CSI_HEADER), "truncated header")
        .when((family == "raw_csi") & (antennas == 0), "zero antennas")
        .when((family == "raw_csi") & (subcarriers == 0), "zero subcarriers")
        .when((family == "raw_csi") & (n < CSI_HEADER + 2 * pairs), "truncated payload")
        .when((family == "edge_vitals") & (n < VITALS_SIZE), "truncated packet")
        .when((family == "sync") & (n < SYNC_SIZE), "truncated packet")
        .when((family == "wasm_event") & (n < WASM_HEADER), "truncated header")
        .when((family == "wasm_event") & (events > WASM_MAX_EVENTS), "too many events")
        .when((family == "wasm_event") & (n < WASM_HEADER + WASM_EVENT_SIZE * events), "truncated payload")
    )
    rows = rows.withColumn("family", family).withColumn("error", error)
    samples = F.when(F.col("error").isNull() & (F.col("family") == "raw_csi"), b.raw(p, CSI_HEADER, 2 * pairs))
    rows = rows.withColumn("_iq", _signed_bytes(samples))
    ok = lambda name: F.col("error").isNull() & (F.col("family") == name)
    bit = lambda value, mask: value.bitwiseAND(mask) != 0

    flags = b.uint(h, 19, 1)
    raw_csi = F.struct(
        b.uint(h, 4, 1).alias("node_id"), antennas.alias("antennas"), subcarriers.alias("subcarriers"),
        b.uint(h, 8, 4).alias("frequency_mhz"), band(b.uint(h, 8, 4)).alias("band"), b.uint(h, 12, 4).alias("sequence"),
        b.sint(h, 16, 1).alias("rssi_dbm"), b.sint(h, 17, 1).alias("noise_floor_dbm"), b.uint(h, 18, 1).alias("ppdu_type"),
        F.when(bit(flags, 1), 40).otherwise(20).alias("bandwidth_mhz"), bit(flags, 4).alias("stbc"), bit(flags, 16).alias("sync_valid"),
        iq(F.col("_iq")).alias("iq"), b.raw(p, CSI_HEADER + 2 * pairs, n).alias("trailing"),
    )
    vflags = b.uint(h, 5, 1)
    vitals = F.struct(
        b.uint(h, 4, 1).alias("node_id"), bit(vflags, 1).alias("presence"), bit(vflags, 2).alias("fall"), bit(vflags, 4).alias("motion"),
        (b.uint(h, 6, 2) / 100.0).alias("breathing_bpm"), (b.uint(h, 8, 4) / 10000.0).alias("heart_bpm"), b.sint(h, 12, 1).alias("rssi_dbm"),
        b.uint(h, 13, 1).alias("persons"), b.float32(h, 16).alias("motion_energy"), b.float32(h, 20).alias("presence_score"),
        b.uint(h, 24, 4).alias("timestamp_ms"), b.raw(p, VITALS_SIZE, n).alias("trailing"),
    )
    wasm = F.struct(
        b.uint(h, 4, 1).alias("node_id"), b.uint(h, 5, 1).alias("module_id"),
        F.when(events > 0, F.transform(
            F.sequence(F.lit(0), events.cast("int") - 1),
            lambda k: F.struct(
                b.uint(h, WASM_HEADER + WASM_EVENT_SIZE * k, 1).alias("event_type"),
                b.float32(h, WASM_HEADER + WASM_EVENT_SIZE * k + 1).alias("value"),
            ),
        )).alias("events"),
        b.raw(p, WASM_HEADER + WASM_EVENT_SIZE * events, n).alias("trailing"),
    )
    sync = F.struct(
        b.uint(h, 4, 1).alias("node_id"), b.uint(h, 5, 1).alias("protocol"), b.uint(h, 6, 1).alias("flags"),
        b.uint(h, 8, 8).alias("local_us"), b.uint(h, 16, 8).alias("epoch_us"), b.uint(h, 24, 4).alias("sequence"),
        b.raw(p, SYNC_SIZE, n).alias("trailing"),
    )
    return rows.select(
        *df.columns, "family", "error",
        F.when(ok("raw_csi"), raw_csi).alias("raw_csi"), F.when(ok("edge_vitals"), vitals).alias("edge_vitals"),
        F.when(ok("wasm_event"), wasm).alias("wasm_event"), F.when(ok("sync"), sync).alias("sync"),
    )


def encode_raw_csi(node, antennas, subcarriers, mhz, seq, rssi, noise, ppdu, flags, iq_hex: Column) -> Column:
    head = [b.hex_uint(F.lit(RAW_CSI), 4), b.hex_uint(node, 1), b.hex_uint(antennas, 1), b.hex_uint(subcarriers, 2), b.hex_uint(mhz, 4),
            b.hex_uint(seq, 4), b.hex_sint(rssi, 1), b.hex_sint(noise, 1), b.hex_uint(ppdu, 1), b.hex_uint(flags, 1)]
    return F.unhex(F.concat(*head, iq_hex))


def encode_vitals(node, flags, breathing_raw, heart_raw, rssi, persons, energy, score, at_ms) -> Column:
    return F.unhex(F.concat(
        b.hex_uint(F.lit(EDGE_VITALS), 4), b.hex_uint(node, 1), b.hex_uint(flags, 1), b.hex_uint(breathing_raw, 2), b.hex_uint(heart_raw, 4),
        b.hex_sint(rssi, 1), b.hex_uint(persons, 1), F.lit("0000"), b.hex_float32(energy), b.hex_float32(score), b.hex_uint(at_ms, 4), F.lit("00000000"),
    ))


def encode_wasm(node, module, events: list[tuple[Column, Column]]) -> Column:
    body = [x for kind, value in events for x in (b.hex_uint(kind, 1), b.hex_float32(value))]
    return F.unhex(F.concat(b.hex_uint(F.lit(WASM_EVENT), 4), b.hex_uint(node, 1), b.hex_uint(module, 1), b.hex_uint(F.lit(len(events)), 2), *body))


def encode_sync(node, local_us, epoch_us, seq) -> Column:
    return F.unhex(F.concat(
        b.hex_uint(F.lit(SYNC), 4), b.hex_uint(node, 1), F.lit("010000"), b.hex_uint(local_us, 8), b.hex_uint(epoch_us, 8), b.hex_uint(seq, 4), F.lit("00000000"),
    ))
