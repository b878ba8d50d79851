"""Canonical frame bytes, witnesses and daily pseudonyms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleframe.sources import binary as b
from rippleframe.sources.hashing import blake3


def float_bytes(values: Column, width: int) -> Column:
    """Little-endian bytes of a float array; ``width`` is 4 or 8."""

    @F.pandas_udf(T.BinaryType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else np.asarray(x, dtype=f"<f{width}").tobytes())

    return run(values)


def frame_bytes(
    frame_id: Column, seconds: Column, nanos: Column, device: Column, band: Column, channel: Column, bandwidth: Column,
    tx: Column, rx: Column, spacing_hex: Column, rssi: Column, noise: Column, sequence: Column, calibration: Column,
    model: Column, version: Column, streams: Column, subcarriers: Column, samples: Column,
) -> Column:
    """Fixed layout of a frame; ``samples`` alternates real and imaginary parts.

    ``spacing_hex`` is the float32 hex of the antenna spacing, or null.
    ``calibration`` is a 16-byte id, or null.
    """
    name = F.encode(device, "UTF-8")
    head = F.concat(
        F.hex(frame_id), b.hex_sint(seconds, 8), b.hex_uint(nanos, 4), b.hex_uint(F.length(name), 4), F.hex(name),
        b.hex_uint(band, 1), b.hex_uint(channel, 1), b.hex_uint(bandwidth, 2), b.hex_uint(tx, 1), b.hex_uint(rx, 1),
        F.coalesce(F.concat(F.lit("01"), spacing_hex), F.lit("0000000000")), b.hex_sint(rssi, 1), b.hex_sint(noise, 1),
        b.hex_uint(sequence, 4), F.coalesce(F.hex(calibration), F.lit("00" * 16)), b.hex_uint(model, 2), b.hex_uint(version, 2),
        b.hex_uint(streams, 4), b.hex_uint(subcarriers, 4),
    )
    return F.concat(F.unhex(head), float_bytes(samples, 8))


def witness(data: Column) -> Column:
    return F.lower(F.hex(blake3(data)))


def day_epoch(unix_seconds: Column) -> Column:
    return F.floor(unix_seconds / 86_400)


def daily_pseudonym(site_salt: bytes, day: Column, features: Column) -> Column:
    """Keyed hash of the day and the float32 features: stable within a day, not across days."""
    message = F.concat(F.unhex(b.hex_uint(day, 4)), float_bytes(features, 4))
    return F.lower(F.hex(blake3(message, site_salt)))


def audit_digest(previous: Column, mode: Column, bits: Column, class_byte: Column) -> Column:
    """Digest of one privacy-mode proof over the digest before it."""
    return blake3(F.concat(previous, F.unhex(F.concat(b.hex_uint(mode, 1), b.hex_uint(bits, 1), b.hex_uint(class_byte, 1)))))


def provenance_witness(evidence: Column, *versions: Column, privacy_class: Column) -> Column:
    """Hash of evidence strings, each followed by a unit separator, then the version strings and class."""
    marked = F.transform(evidence, lambda e: F.concat(F.hex(F.encode(e, "UTF-8")), F.lit("1F")))
    tail = [F.hex(F.encode(v, "UTF-8")) for v in versions]
    return witness(F.unhex(F.concat(F.array_join(marked, ""), *tail, b.hex_uint(privacy_class, 1))))
