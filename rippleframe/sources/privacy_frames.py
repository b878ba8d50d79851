"""Privacy frames: an 86-byte header and length-prefixed payload sections, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.sources import binary as b

# Fixed values of the frame format and privacy modes.
MAGIC = 0xBF1D0001
VERSION = 1
HEADER = 86
HAS_DELTA = 1
SECTIONS = ["angle_matrix", "amplitude_proxy", "phase_proxy", "snr_vector", "csi_delta", "vendor"]
CLASSES = {"raw": 0, "derived": 1, "anonymous": 2, "restricted": 3}
# Actions are bits 0..4: allow, suppress identity, reduce resolution, drop raw, aggregate only.
ALLOW, SUPPRESS, REDUCE, DROP_RAW, AGGREGATE = (1 << i for i in range(5))
MODE_BITS = {
    "RawResearch": ALLOW,
    "PrivateHome": SUPPRESS | DROP_RAW,
    "EnterpriseAnonymous": SUPPRESS | DROP_RAW | AGGREGATE,
    "CareWithConsent": ALLOW,
    "StrictNoIdentity": SUPPRESS | REDUCE | DROP_RAW | AGGREGATE,
}
MODE_CLASS = {"RawResearch": 0, "PrivateHome": 2, "EnterpriseAnonymous": 2, "CareWithConsent": 1, "StrictNoIdentity": 3}


def _section(data: Column) -> Column:
    return F.concat(F.unhex(b.hex_uint(F.length(data), 4)), data)


def payload(sections: dict[str, Column]) -> Column:
    """Length-prefixed sections; the delta section is left out when null."""
    empty = F.unhex(F.lit(""))
    parts = []
    for name in SECTIONS:
        data = sections[name]
        if name == "csi_delta":
            parts.append(F.coalesce(F.when(data.isNotNull(), _section(data)), empty))
        else:
            parts.append(_section(F.coalesce(data, empty)))
    return F.concat(*parts)


def encode(header: dict[str, Column], body: Column, has_delta: Column) -> Column:
    """Frame bytes with length, checksum and delta flag in step with the payload.

    ``header`` holds timestamp_ns, ap_hash, sta_hash, session_id (16 bytes each),
    channel, bandwidth_mhz, rssi_dbm, noise_floor_dbm, n_subcarriers, n_tx, n_rx,
    quantization and privacy_class.
    """
    flags = F.when(has_delta, F.lit(HAS_DELTA)).otherwise(F.lit(0))
    g = header
    head = F.concat(
        b.hex_uint(F.lit(MAGIC), 4), b.hex_uint(F.lit(VERSION), 2), b.hex_uint(flags, 2), b.hex_uint(g["timestamp_ns"], 8),
        F.hex(g["ap_hash"]), F.hex(g["sta_hash"]), F.hex(g["session_id"]), b.hex_uint(g["channel"], 2), b.hex_uint(g["bandwidth_mhz"], 2),
        b.hex_sint(g["rssi_dbm"], 2), b.hex_sint(g["noise_floor_dbm"], 2), b.hex_uint(g["n_subcarriers"], 2), b.hex_uint(g["n_tx"], 1),
        b.hex_uint(g["n_rx"], 1), b.hex_uint(g["quantization"], 1), b.hex_uint(g["privacy_class"], 1), b.hex_uint(F.length(body), 4), b.hex_uint(F.crc32(body), 4),
    )
    return F.concat(F.unhex(head), body)


def decode(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Add header fields, sections and ``error``; sections are null on a bad frame."""
    f = F.col(frame)
    h, n = f, F.length(f)
    out = df.withColumns({
        "flags": b.uint(h, 6, 2), "timestamp_ns": b.uint(h, 8, 8), "ap_hash": b.raw(f, 16, 16), "sta_hash": b.raw(f, 32, 16),
        "session_id": b.raw(f, 48, 16), "channel": b.uint(h, 64, 2), "bandwidth_mhz": b.uint(h, 66, 2), "rssi_dbm": b.sint(h, 68, 2),
        "noise_floor_dbm": b.sint(h, 70, 2), "n_subcarriers": b.uint(h, 72, 2), "n_tx": b.uint(h, 74, 1), "n_rx": b.uint(h, 75, 1),
        "quantization": b.uint(h, 76, 1), "privacy_class": b.uint(h, 77, 1), "payload_len": b.uint(h, 78, 4), "payload_crc": b.uint(h, 82, 4),
    })
    body = b.raw(f, HEADER, F.col("payload_len"))
    out = out.withColumn("_body", body).withColumn(
        "error",
        F.when(n < HEADER, "truncated header").when(b.uint(h, 0, 4) != MAGIC, "bad magic").when(b.uint(h, 4, 2) != VERSION, "bad version")
        .when(n < HEADER + F.col("payload_len"), "truncated payload").when(F.crc32("_body") != F.col("payload_crc"), "bad checksum")
        .when(~F.col("privacy_class").isin(*CLASSES.values()), "unknown privacy class"),
    )
    out = out.withColumn("_at", F.lit(0).cast("bigint"))
    for name in SECTIONS:
        present = F.col("flags").bitwiseAND(HAS_DELTA) != 0 if name == "csi_delta" else F.lit(True)
        size = F.when(present & (F.col("_at") + 4 <= F.length("_body")), b.uint(F.col("_body"), F.col("_at"), 4))
        out = out.withColumn("_size", size)
        whole = F.col("_size").isNotNull() & (F.col("_at") + 4 + F.col("_size") <= F.length("_body"))
        out = out.withColumn(name, F.when(whole & F.col("error").isNull(), b.raw(F.col("_body"), F.col("_at") + 4, F.col("_size"))))
        out = out.withColumn("_at", F.when(present, F.col("_at") + 4 + F.col("_size")).otherwise(F.col("_at")))
    out = out.withColumn("error", F.coalesce("error", F.when(~F.coalesce(F.col("_at") == F.length("_body"), F.lit(False)), F.lit("malformed sections"))))
    return out.drop("_body", "_at", "_size")


def demote(df: DataFrame, target: Column) -> DataFrame:
    """Strip sections for a stricter class.

    Rows that ask for a less strict class, whose target or class is null or unknown, or
    whose payload does not parse, keep ``error`` set and no sections, so that nothing
    unstripped gets relabelled.
    """
    known = target.isin(*CLASSES.values()) & F.col("privacy_class").isin(*CLASSES.values())
    loose = ~F.coalesce(known & (target >= F.col("privacy_class")), F.lit(False))
    bad = F.coalesce(F.col("error"), F.when(loose, F.lit("demotion must be stricter")))
    empty = F.unhex(F.lit(""))
    out = df.withColumn("error", bad)
    keep = lambda name, limit: F.when(F.col("error").isNull(), F.when(target >= limit, empty).otherwise(F.col(name)))
    return (
        out.withColumn("angle_matrix", keep("angle_matrix", CLASSES["anonymous"]))
        .withColumn("csi_delta", F.when(F.col("error").isNull() & (target < CLASSES["anonymous"]), F.col("csi_delta")))
        .withColumn("amplitude_proxy", keep("amplitude_proxy", CLASSES["restricted"]))
        .withColumn("phase_proxy", keep("phase_proxy", CLASSES["restricted"]))
        .withColumn("privacy_class", F.when(F.col("error").isNull(), target).otherwise(F.col("privacy_class")))
    )


def enforces(mode: str, action: int) -> bool:
    return bool(MODE_BITS[mode] & action)


def demote_class(privacy_class: Column) -> Column:
    return F.least(privacy_class + 1, F.lit(3))
