"""Packets, privacy frames, hashes and recordings derived from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import vectors as vec
from rippleframe.plans.registry import Tables, query, r6
from rippleframe.session import durable
from rippleframe.sources import binary as b
from rippleframe.sources import canonical, packets, replay
from rippleframe.sources import privacy_frames as pf


def _datagrams(spark, sf_dir):
    """One datagram per event: its type picks the family, purchases are unknown packets."""
    ev = Tables(spark, sf_dir).events
    cents = F.round(F.col("value") * 100).cast("bigint")
    node = F.col("user_id") % 256
    iq = F.concat(*[b.hex_uint((cents * (i + 1) + 31 * i) % 256, 1) for i in range(12)])
    quarter = F.floor(F.col("value")) / 4
    packet = (
        F.when(F.col("event_type") == "view", packets.encode_raw_csi(node, F.lit(2), F.lit(3), F.lit(2412) + node * 20, F.col("event_id"), -(cents % 90), F.lit(-95), F.lit(1), cents % 32, iq))
        .when(F.col("event_type") == "error", packets.encode_vitals(node, cents % 8, cents % 4000, cents * 7, -(cents % 90), cents % 4, quarter, quarter / 8, F.col("event_id")))
        .when(F.col("event_type") == "click", packets.encode_wasm(node, cents % 200, [(cents % 9, quarter), (cents % 7, -quarter)]))
        .when(F.col("event_type") == "signup", packets.encode_sync(node, cents * 1_000_003, cents * 2_000_003, F.col("event_id")))
        .otherwise(F.unhex(F.lit("070000C5AA")))
    )
    # Written out as the raw datagram table that a receiver would have left.
    return durable(ev.select("event_id", packet.alias("packet")), "datagrams")


_I8 = "CASE WHEN {0} >= 128 THEN {0} - 256 ELSE {0} END"
_AMPS = " + ".join(
    f"sqrt(({_I8.format(f'((c * {2 * k + 1} + {62 * k}) % 256)')})^2 + ({_I8.format(f'((c * {2 * k + 2} + {62 * k + 31}) % 256)')})^2)" for k in range(6)
)


@query(
    f"""WITH p AS (SELECT event_id, event_type AS t, user_id % 256 AS node, round(value * 100)::BIGINT AS c, floor(value) / 4 AS q FROM events)
SELECT event_id, CASE t WHEN 'view' THEN 'raw_csi' WHEN 'error' THEN 'edge_vitals' WHEN 'click' THEN 'wasm_event' WHEN 'signup' THEN 'sync' END AS family,
  CASE WHEN t = 'purchase' THEN 'unknown magic' END AS error, CASE WHEN t <> 'purchase' THEN node END AS node_id,
  CASE WHEN t = 'view' THEN round(({_AMPS}) / 6, 6) END AS mean_amplitude,
  CASE WHEN t = 'view' THEN CASE WHEN 2412 + node * 20 >= 5925 THEN '6GHz' WHEN 2412 + node * 20 >= 4900 THEN '5GHz' ELSE '2.4GHz' END END AS band,
  CASE WHEN t IN ('view', 'error') THEN -(c % 90) END AS rssi_dbm, CASE WHEN t = 'error' THEN (c % 4000) / 100.0 END AS breathing_bpm,
  CASE WHEN t = 'error' THEN q WHEN t = 'click' THEN -q END AS reading,
  CASE WHEN t = 'signup' THEN (c * 2000003 - c * 1000003)::BIGINT END AS offset_us FROM p"""
)
def packet_decode(spark, sf_dir):
    """Build datagrams from events and decode all four families."""
    out = packets.decode(_datagrams(spark, sf_dir))
    amp = F.transform("raw_csi.iq", lambda z: F.hypot(z["re"], z["im"]))
    pick = lambda f: F.coalesce(*[F.col(f"{s}.{f}") for s in ("raw_csi", "edge_vitals", "wasm_event", "sync")])
    return out.select(
        "event_id", "family", "error", pick("node_id").alias("node_id"),
        r6(vec.mean(amp)).alias("mean_amplitude"), F.col("raw_csi.band").alias("band"),
        F.coalesce("raw_csi.rssi_dbm", "edge_vitals.rssi_dbm").alias("rssi_dbm"), F.col("edge_vitals.breathing_bpm").alias("breathing_bpm"),
        F.coalesce(F.col("edge_vitals.motion_energy"), F.element_at("wasm_event.events", 2)["value"]).alias("reading"),
        (F.col("sync.epoch_us") - F.col("sync.local_us")).cast("bigint").alias("offset_us"),
    )


def _frames(spark, sf_dir):
    """Privacy frames whose sections are pieces of the document text."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", F.encode("text", "UTF-8").alias("t"), (F.col("doc_id") % 3).cast("int").alias("cls"))
    sections = {
        "angle_matrix": F.substr("t", F.lit(1), F.lit(40)),
        "amplitude_proxy": F.substr("t", F.lit(41), F.lit(30)),
        "phase_proxy": F.substr("t", F.lit(71), F.lit(20)),
        "snr_vector": F.col("t"),
        "csi_delta": F.when(F.col("doc_id") % 2 == 0, F.substr("t", F.lit(1), F.lit(9))),
        "vendor": F.encode("lang", "UTF-8"),
    }
    body = pf.payload(sections)
    hash16 = F.unhex(F.md5("t"))
    header = {
        "timestamp_ns": F.col("doc_id") * 1_000_000_007, "ap_hash": hash16, "sta_hash": hash16, "session_id": hash16, "channel": F.lit(36),
        "bandwidth_mhz": F.lit(80), "rssi_dbm": F.lit(-47), "noise_floor_dbm": F.lit(-92), "n_subcarriers": F.lit(56), "n_tx": F.lit(1),
        "n_rx": F.lit(3), "quantization": F.lit(8), "privacy_class": F.col("cls"),
    }
    frame = pf.encode(header, body, F.col("doc_id") % 2 == 0)
    return durable(d.select("doc_id", frame.alias("frame")), "frames")


@query(
    """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, doc_id % 3 AS c, octet_length(encode(lang)) AS v, md5(text) AS h FROM documents)
SELECT doc_id, c AS privacy_class, h AS ap_hash, (doc_id * 1000000007)::BIGINT AS timestamp_ns, -47 AS rssi_dbm, least(n, 40)::BIGINT AS angle_bytes, greatest(0, least(n - 40, 30))::BIGINT AS amplitude_bytes,
  greatest(0, least(n - 70, 20))::BIGINT AS phase_bytes, n AS snr_bytes, CASE WHEN doc_id % 2 = 0 THEN least(n, 9) END AS delta_bytes, v AS vendor_bytes, NULL::VARCHAR AS error FROM d"""
)
def privacy_frame_decode(spark, sf_dir):
    """Encode frames from whole documents, decode and verify the checksum."""
    out = pf.decode(_frames(spark, sf_dir))
    size = lambda c, name: F.length(c).cast("bigint").alias(name)
    return out.select(
        "doc_id", "privacy_class", F.lower(F.hex("ap_hash")).alias("ap_hash"), F.col("timestamp_ns").cast("bigint").alias("timestamp_ns"),
        F.col("rssi_dbm").cast("int").alias("rssi_dbm"), size("angle_matrix", "angle_bytes"), size("amplitude_proxy", "amplitude_bytes"),
        size("phase_proxy", "phase_bytes"), size("snr_vector", "snr_bytes"), size("csi_delta", "delta_bytes"), size("vendor", "vendor_bytes"), "error",
    )


@query(
    """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, doc_id % 3 AS c, doc_id % 4 AS t FROM documents)
SELECT doc_id, greatest(c, CASE WHEN t >= c THEN t ELSE c END) AS privacy_class, CASE WHEN t < c THEN 'demotion must be stricter' END AS error,
  CASE WHEN t < c THEN NULL WHEN t >= 2 THEN 0 ELSE least(n, 40) END::BIGINT AS angle_bytes,
  CASE WHEN t < c THEN NULL WHEN t >= 3 THEN 0 ELSE greatest(0, least(n - 40, 30)) END::BIGINT AS amplitude_bytes,
  CASE WHEN t < c OR t >= 2 OR doc_id % 2 = 1 THEN NULL ELSE least(n, 9) END::BIGINT AS delta_bytes FROM d"""
)
def privacy_demote(spark, sf_dir):
    """Demote frames to the class of the row; a laxer class is refused."""
    out = pf.demote(pf.decode(_frames(spark, sf_dir)), F.col("doc_id") % 4)
    size = lambda c, name: F.length(c).cast("bigint").alias(name)
    return out.select("doc_id", "privacy_class", "error", size("angle_matrix", "angle_bytes"), size("amplitude_proxy", "amplitude_bytes"), size("csi_delta", "delta_bytes"))


@query()
def witness_hash(spark, sf_dir):
    """BLAKE3 witness of the canonical bytes of every frame (32 complex subcarriers)."""
    em = Tables(spark, sf_dir).embeddings
    samples = F.flatten(F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda r, i: F.array(r.cast("double"), i.cast("double"))))
    ident = F.unhex(F.lpad(F.hex("vec_id"), 32, "0"))
    lit = F.lit
    data = canonical.frame_bytes(
        ident, lit(1_700_000_000), F.col("vec_id"), F.concat(lit("node-"), F.col("label").cast("string")), lit(1), lit(36), lit(20), lit(1), lit(3),
        lit(None).cast("string"), lit(-50), lit(-90), F.col("vec_id"), lit(None).cast("binary"), lit(7), lit(258), lit(1), lit(32), samples,
    )
    return em.select("vec_id", canonical.witness(data).alias("witness"))


@query()
def daily_pseudonyms(spark, sf_dir):
    """Keyed daily pseudonym of every frame's features; changes from day to day."""
    em = Tables(spark, sf_dir).embeddings
    day = F.lit(19_700) + F.col("vec_id") % 30
    return em.select("vec_id", day.alias("day"), canonical.daily_pseudonym(b"rippleframe test site salt 32 by", day, F.col("embedding")).alias("pseudonym"))


@query(
    """WITH p AS (SELECT conv_id, turn, role, text, sha256(role || ':' || text) AS h FROM conversations)
SELECT conv_id, turn, h AS digest FROM p"""
)
def content_digest(spark, sf_dir):
    """SHA-256 over whole texts."""
    c = Tables(spark, sf_dir).conversations
    return c.select("conv_id", "turn", F.sha2(F.concat("role", F.lit(":"), "text"), 256).alias("digest"))


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value AS v, event_type AS t FROM events WHERE event_type <> 'signup'),
a AS (SELECT *, CASE WHEN t = 'purchase' THEN [1.0, 1.4, 0.8, 1.2] WHEN t = 'view' THEN [v / 100 + 1, v / 203 + 1, 1.0, v / 57] WHEN t = 'click' THEN [] ELSE [v / 31 + 1, 1.0, 1.1, 1.0, 0.9, 1.0, 1.05] END AS amp FROM e),
s AS (SELECT *, CASE WHEN len(amp) > 0 THEN list_avg(amp) ELSE 0 END AS m, CASE WHEN len(amp) > 0 THEN list_var_pop(amp) ELSE 0 END AS var FROM a),
d AS (SELECT *, greatest(0, least(1, sqrt(var) / (abs(m) + 1e-9))) AS score FROM s),
c AS (SELECT event_id, count(*) FILTER (st > lim) AS cp FROM (SELECT event_id, st, avg(st) OVER (PARTITION BY event_id) + 2 * stddev_pop(st) OVER (PARTITION BY event_id) AS lim
  FROM (SELECT event_id, unnest(list_transform(range(2, len(amp) + 1), lambda i: abs(amp[i] - amp[i - 1]))) AS st FROM a WHERE len(amp) >= 3)) GROUP BY event_id),
p AS (SELECT d.*, coalesce(cp, 0) AS cp, CASE WHEN t = 'error' THEN v > 40 ELSE score > 0.04 END AS pr FROM d LEFT JOIN c USING (event_id))
SELECT event_id, CASE WHEN t = 'purchase' THEN event_id * 3 ELSE event_id END AS tick, CASE WHEN t = 'purchase' THEN 'n' || user_id WHEN t = 'view' THEN 'n' || user_id ELSE 'replay-node-1' END AS node_id,
  round(score, 6) AS motion_score, pr AS presence, CASE WHEN NOT pr THEN 'absent' WHEN score > 0.25 THEN 'active' WHEN score > 0.12 THEN 'present_moving' ELSE 'present_still' END AS motion_level,
  round(CASE WHEN pr THEN score ELSE 1 - score END, 6) AS confidence, cp AS change_points FROM p"""
)
def replay_records(spark, sf_dir):
    """Recordings as JSON lines with four shapes, comments and blanks; normalised to updates."""
    ev = Tables(spark, sf_dir).events
    v, t, node = F.col("value"), F.col("event_type"), F.concat(F.lit("n"), F.col("user_id").cast("string"))
    one = F.lit(1.0)
    line = (
        F.when(t == "purchase", F.to_json(F.struct(
            F.lit("sensing_update").alias("type"), (F.col("event_id") * 3).alias("tick"), F.array(F.struct(node.alias("node_id"))).alias("nodes"),
            F.array(one, F.lit(1.4), F.lit(0.8), F.lit(1.2)).alias("amplitude"))))
        .when(t == "view", F.to_json(F.struct(node.alias("node_id"), F.array(v / 100 + 1, v / 203 + 1, one, v / 57).alias("subcarriers"), F.array(one).alias("csi"))))
        .when(t == "click", F.to_json(F.struct(F.lit(-47).alias("rssi"))))
        .when(t == "error", F.to_json(F.struct((v > 40).alias("presence"), F.array(v / 31 + 1, one, F.lit(1.1), one, F.lit(0.9), one, F.lit(1.05)).alias("csi"))))
        .when(F.col("event_id") % 2 == 0, F.lit("  # comment")).otherwise(F.lit("  "))
    )
    rows = replay.records(ev.select("event_id", line.alias("line")), "line")
    out = replay.to_updates(rows, "line", F.col("event_id"))
    return out.select(
        "event_id", "tick", "node_id", r6("motion_score").alias("motion_score"), "presence", "motion_level", r6("confidence").alias("confidence"),
        F.col("change_points").cast("bigint").alias("change_points"),
    )
