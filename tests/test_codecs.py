import hashlib
import math
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippleframe.sources import binary as b
from rippleframe.sources import canonical, packets, replay
from rippleframe.sources import privacy_frames as pf
from rippleframe.sources.hashing import blake3_batch


def one(frame, data):
    return packets.decode(frame([(bytearray(data),)], "packet binary")).first()


HEADER = struct.pack("<IBBHIIbbBB", 0xC5110001, 7, 2, 3, 2412, 42, -55, -95, 1, 0x11)
IQ = bytes([3, 4, 255, 0, 0, 128, 5, 12, 9, 40, 0, 1])


def test_raw_packet_fixture(frame):
    r = one(frame, HEADER + IQ + b"extra")
    assert r.family == "raw_csi" and r.error is None
    c = r.raw_csi
    assert (c.node_id, c.antennas, c.subcarriers, c.frequency_mhz, c.sequence, c.rssi_dbm, c.noise_floor_dbm) == (7, 2, 3, 2412, 42, -55, -95)
    assert c.bandwidth_mhz == 40 and c.sync_valid and not c.stbc and c.band == "2.4GHz"
    assert [(z.re, z.im) for z in c.iq] == [(3, 4), (-1, 0), (0, -128), (5, 12), (9, 40), (0, 1)]
    assert bytes(c.trailing) == b"extra"


@pytest.mark.parametrize(
    "data, error",
    [
        (b"\x01", "truncated magic"),
        (b"\x00" * 20, "unknown magic"),
        (HEADER[:12], "truncated header"),
        (HEADER + IQ[:-1], "truncated payload"),
        (HEADER[:5] + b"\x00" + HEADER[6:] + IQ, "zero antennas"),
        (HEADER[:6] + b"\x00\x00" + HEADER[8:] + IQ, "zero subcarriers"),
        (struct.pack("<IBBH", 0xC5110004, 1, 2, 17), "too many events"),
        (struct.pack("<IB", 0xC5110002, 1), "truncated packet"),
    ],
)
def test_bad_packets_are_kept_with_a_reason(frame, data, error):
    r = one(frame, data)
    assert r.error == error and bytes(r.packet) == data
    assert r.raw_csi is None and r.edge_vitals is None and r.wasm_event is None and r.sync is None


def test_other_families(frame):
    v = one(frame, struct.pack("<IBBHIbB2sffII", 0xC5110002, 9, 5, 1625, 723456, -60, 2, b"\0\0", 0.37, -1.5e-3, 123456, 0)).edge_vitals
    assert (v.breathing_bpm, v.heart_bpm, v.presence, v.fall, v.motion, v.persons) == (16.25, 72.3456, True, False, True, 2)
    assert v.motion_energy == np.float32(0.37) and v.presence_score == np.float32(-1.5e-3)
    w = one(frame, struct.pack("<IBBH", 0xC5110004, 1, 3, 2) + struct.pack("<Bf", 4, 2.5) + struct.pack("<Bf", 5, float("-inf"))).wasm_event
    assert [(e.event_type, e.value) for e in w.events] == [(4, 2.5), (5, -math.inf)]
    s = one(frame, struct.pack("<IBBBBQQII", 0xC511A110, 1, 1, 0, 0, 2**63 + 5, 2**64 - 1, 77, 0)).sync
    assert (s.local_us, s.epoch_us, s.sequence) == (2**63 + 5, 2**64 - 1, 77)


def test_float_bits_round_trip(spark):
    values = [0.0, 1.0, -2.5, 0.1, 3.4e38, 1.2e-38, 1e-45, 8.0, 0.99999994]
    raw = spark.createDataFrame([(struct.pack("<f", v).hex().upper(), float(np.float32(v))) for v in values], "h string, v double")
    assert raw.filter(b.float32(F.unhex("h"), 0) != F.col("v")).count() == 0
    normal = raw.filter((F.col("v") == 0) | (F.abs("v") >= 1.2e-38))
    assert normal.filter(b.hex_float32(F.col("v")) != F.col("h")).count() == 0


def test_blake3_known_answers():
    assert blake3_batch([b""])[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    long = bytes(i % 251 for i in range(5000))
    assert blake3_batch([b"a", long, b"b"])[1] == blake3_batch([long])[0]
    assert blake3_batch([b"a"], b"k" * 32) != blake3_batch([b"a"])


def test_witness_golden_vector(spark):
    lit = F.lit
    samples = F.array(*[lit(x) for z in (0.5 + 0j, 1.0 + 0.25j, 1.5 - 0.5j, 2.0 + 0.75j) for x in (z.real, z.imag)])
    ident = lit(bytearray(uuid.UUID("00000000-0000-0000-0000-000000000001").bytes))
    none = lit(None).cast("string")
    data = canonical.frame_bytes(
        ident, lit(1_700_000_000), lit(123), lit("node-1"), lit(1), lit(36), lit(20), lit(1), lit(3), none, lit(-50), lit(-90), lit(99),
        lit(None).cast("binary"), lit(7), lit(0x0102), lit(2), lit(2), samples,
    )
    got = spark.range(1).select(canonical.witness(data).alias("w")).first().w
    assert got == "9ac4fdb9b6b9b2cca62b6ac6751a50400d49146d16435a7d3aed8350e01d983e"


def test_pseudonym_changes_by_day(spark):
    f = F.array(F.lit(0.25), F.lit(1.5))
    salt = bytes(range(32))
    df = spark.range(3).select(canonical.daily_pseudonym(salt, F.lit(19_700) + F.floor(F.col("id") / 2), f).alias("p"))
    p = [r.p for r in df.collect()]
    assert p[0] == p[1] != p[2]
    assert p[0] == blake3_batch([struct.pack("<I", 19_700) + struct.pack("<2f", 0.25, 1.5)], salt)[0].hex()


def test_audit_chain_verifies_row_by_row(spark):
    """Each proof checks on its own against the digest before it."""
    chain, prev = [], bytes(32)
    for mode, bits, cls in [(0, 1, 0), (1, 10, 2), (4, 30, 3)]:
        digest = blake3_batch([prev + bytes([mode, bits, cls])])[0]
        chain.append((len(chain), mode, bits, cls, bytearray(prev), bytearray(digest)))
        prev = digest
    df = spark.createDataFrame(chain, "n int, mode int, bits int, cls int, prev binary, hash binary")
    again = canonical.audit_digest(F.col("prev"), F.col("mode"), F.col("bits"), F.col("cls"))
    assert df.filter(again != F.col("hash")).count() == 0
    assert df.withColumn("bits", F.lit(2)).filter(again != F.col("hash")).count() == 3


def test_provenance_witness(spark):
    w = canonical.provenance_witness(F.array(F.lit("a"), F.lit("bc")), F.lit("m1"), F.lit("cal:none"), F.lit("X/Y"), privacy_class=F.lit(2))
    assert spark.range(1).select(w.alias("w")).first().w == blake3_batch([b"a\x1fbc\x1fm1cal:noneX/Y\x02"])[0].hex()


def frames(spark, delta=True):
    text = lambda s: F.lit(bytearray(s))
    sections = {"angle_matrix": text(b"angle"), "amplitude_proxy": text(b"amp"), "phase_proxy": text(b""), "snr_vector": text(b"\x00\xff"),
                "csi_delta": text(b"delta") if delta else F.lit(None).cast("binary"), "vendor": text(b"v")}
    h = text(hashlib.md5(b"x").digest())
    header = dict(timestamp_ns=F.lit(2**40), ap_hash=h, sta_hash=h, session_id=h, channel=F.lit(36), bandwidth_mhz=F.lit(80), rssi_dbm=F.lit(-47),
                  noise_floor_dbm=F.lit(-92), n_subcarriers=F.lit(56), n_tx=F.lit(1), n_rx=F.lit(3), quantization=F.lit(8), privacy_class=F.lit(0))
    return spark.range(1).select(pf.encode(header, pf.payload(sections), F.lit(delta)).alias("frame"))


@pytest.mark.parametrize("delta", [True, False])
def test_privacy_frame_round_trip(spark, delta):
    df = frames(spark, delta)
    raw = bytes(df.first().frame)
    body = b"".join(struct.pack("<I", len(s)) + s for s in ([b"angle", b"amp", b"", b"\x00\xff"] + ([b"delta"] if delta else []) + [b"v"]))
    import zlib

    md5 = hashlib.md5(b"x").digest()
    head = struct.pack("<IHHQ16s16s16sHHhhHBBBBII", 0xBF1D0001, 1, int(delta), 2**40, md5, md5, md5, 36, 80, -47, -92, 56, 1, 3, 8, 0, len(body), zlib.crc32(body))
    assert raw == head + body
    r = pf.decode(df).first()
    assert r.error is None and r.rssi_dbm == -47 and bytes(r.angle_matrix) == b"angle" and bytes(r.vendor) == b"v"
    assert (bytes(r.csi_delta) if delta else r.csi_delta) == (b"delta" if delta else None)


def test_privacy_frame_errors(spark):
    raw = bytes(frames(spark).first().frame)
    bad = {
        "truncated header": raw[:80], "bad magic": b"\0" + raw[1:], "bad version": raw[:4] + b"\x09" + raw[5:], "truncated payload": raw[:-1],
        "bad checksum": raw[:-1] + bytes([raw[-1] ^ 1]),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in bad.items()], "want string, frame binary")
    got = pf.decode(df).collect()
    assert all(r.error == r.want and r.angle_matrix is None for r in got)


def test_demotion_strips_and_refuses(spark):
    d = pf.decode(frames(spark))
    r = pf.demote(d, F.lit(3)).first()
    assert bytes(r.angle_matrix) == bytes(r.amplitude_proxy) == b"" and r.csi_delta is None and bytes(r.snr_vector) == b"\x00\xff" and r.privacy_class == 3
    r = pf.demote(d.withColumn("privacy_class", F.lit(2).cast("bigint")), F.lit(1)).first()
    assert r.error == "demotion must be stricter" and r.angle_matrix is None and r.privacy_class == 2
    assert pf.enforces("PrivateHome", pf.SUPPRESS) and not pf.enforces("RawResearch", pf.SUPPRESS)


def test_replay_fixture(spark, tmp_path):
    lines = [
        "# recording", "",
        '{"type": "sensing_update", "tick": 41, "nodes": [{"node_id": "n1"}], "classification": {"presence": false, "motion_level": "absent"}}',
        '{"node_id": "replay-node-2", "subcarriers": [1.0, 1.4, 0.8, 1.2], "rssi": -47}',
        "not json",
    ]
    path = tmp_path / "recording.jsonl"
    path.write_text("\n".join(lines))
    rows = replay.read_lines(spark, str(path)).withColumn("n", F.monotonically_increasing_id())
    got = replay.to_updates(rows, "value", F.col("n") + 41).orderBy("n").collect()
    assert [(r.tick, r.node_id, r.presence) for r in got[:2]] == [(41, "n1", False), (42, "replay-node-2", True)]
    assert got[1].rssi_dbm == -47 and got[1].subcarrier_count == 4 and got[1].source == "replay"
    assert got[2].error == "not a JSON object" and got[0].error is None


def test_packet_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.bin").write_bytes(HEADER + IQ)
    out = packets.decode(packets.read_packets(spark, str(tmp_path)))
    assert out.filter("raw_csi.node_id = 7").count() == 3
