"""Decoded packets of every family as rows of one update schema.

An update says what a node reports: nodes, features, classification, vital signs and the estimated
number of persons. Families fill the fields they know and leave the others null. Packets
that do not decode become generic updates with their error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions import scoring as sc
from rippleframe.operators import sequence as seqs
from rippleframe.operators import windows as win
from rippleframe.operators.frame_history import STATS, frame_history

HISTORY = 16
NODE_PREFIX = "esp32-node-"
COLUMNS = ("nodes", "features", "classification", "vital_signs", "estimated_persons")
# The levels that presence states stand for.
LEVELS = {"empty": "absent", "still": "present_still", "moving": "present_moving"}

NODE = """array<struct<node_id string, rssi_dbm double, amplitude array<double>, subcarrier_count int, metadata struct<
 packet_node_id bigint, timestamp_ms bigint, protocol_version bigint, local_us decimal(20,0), epoch_us decimal(20,0), module_id bigint,
 frequency_band string, bandwidth_mhz int, sequence_number bigint, noise_floor_dbm bigint, ppdu_type bigint, sync_valid boolean>>>"""
FEATURES = """struct<packet_type string, raw_bytes int, mean_rssi double, variance double, mean_amplitude double, temporal_delta double, phase_variance double,
 subcarrier_variance double, motion_energy double, motion_band_power double, breathing_band_power double, motion_score double, presence_score double,
 change_points bigint, frame_count bigint, frequency_mhz bigint, sequence_number bigint, sequence_high_water bigint, timestamp_ms bigint, module_id bigint,
 events array<struct<event_type bigint, value double>>>"""
CLASSIFICATION = "struct<motion_level string, presence boolean, confidence double, state string, moving boolean, presence_score double, motion_score double>"
VITALS = "struct<breathing_rate_bpm double, heart_rate_bpm double, motion boolean, fall_detected boolean, n_persons bigint>"


def _fields(kind: str) -> list[tuple[str, str]]:
    """Top-level (name, type) of a struct type string."""
    inner, depth, out, start = kind.strip()[len("struct<") : -1], 0, [], 0
    for i, c in enumerate(inner + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(tuple(inner[start:i].strip().split(" ", 1)))
            start = i + 1
    return out


def fill(kind: str, **known: Column) -> Column:
    """A struct of ``kind`` with the known fields; the rest is null."""
    names = _fields(kind)
    if unknown := set(known) - {n for n, _ in names}:
        raise KeyError(f"not in the update schema: {sorted(unknown)}")
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def _node(**known: Column) -> Column:
    element = NODE.strip()[len("array<") : -1]
    kinds = dict(_fields(element))
    meta = {n: known.pop(n) for n, _ in _fields(kinds["metadata"]) if n in known}
    parts = [fill(kinds["metadata"], **meta) if n == "metadata" else known.get(n, F.lit(None)).cast(t) for n, t in kinds.items()]
    return F.array(F.struct(*[p.alias(n) for p, n in zip(parts, kinds)]))


def _named(node: Column) -> Column:
    return F.concat(F.lit(NODE_PREFIX), node.cast("string"))


def _absent() -> Column:
    return fill(CLASSIFICATION, motion_level=F.lit("absent"), presence=F.lit(False), confidence=F.lit(0.0))


def _update(nodes: Column, features: Column, classification: Column, vitals: Column, persons: Column) -> list[Column]:
    return [nodes.alias("nodes"), features.alias("features"), classification.alias("classification"), vitals.alias("vital_signs"), persons.cast("int").alias("estimated_persons")]


def edge_vitals_update(p: Column, size: Column) -> list[Column]:
    """Columns of the update of an edge-vitals packet."""
    level, state = (F.when(p["motion"], a).when(p["presence"], b).otherwise(c) for a, b, c in (("present_moving", "present_still", "absent"), ("moving", "still", "empty")))
    presence, motion = sc.clamp01_or_zero(p["presence_score"]), sc.clamp01_or_zero(p["motion_energy"])
    return _update(
        _node(node_id=_named(p["node_id"]), rssi_dbm=p["rssi_dbm"], packet_node_id=p["node_id"], timestamp_ms=p["timestamp_ms"]),
        fill(FEATURES, packet_type=F.lit("edge_vitals"), raw_bytes=size, mean_rssi=p["rssi_dbm"], motion_band_power=p["motion_energy"], presence_score=p["presence_score"], timestamp_ms=p["timestamp_ms"]),
        fill(CLASSIFICATION, motion_level=level, presence=p["presence"], confidence=presence, state=state, moving=p["motion"], presence_score=presence, motion_score=motion),
        fill(VITALS, breathing_rate_bpm=p["breathing_bpm"], heart_rate_bpm=p["heart_bpm"], motion=p["motion"], fall_detected=p["fall"], n_persons=p["persons"]),
        p["persons"],
    )


def sync_update(p: Column, size: Column) -> list[Column]:
    """Columns of the update of a sync packet; it says nothing of persons."""
    node = _node(node_id=_named(p["node_id"]), packet_node_id=p["node_id"], protocol_version=p["protocol"], local_us=p["local_us"], epoch_us=p["epoch_us"])
    return _update(node, fill(FEATURES, packet_type=F.lit("sync"), raw_bytes=size, sequence_high_water=p["sequence"]), _absent(), fill(VITALS), F.lit(0))


def wasm_event_update(p: Column, size: Column) -> list[Column]:
    """Columns of the update of a module's events."""
    events = F.coalesce(p["events"], F.array().cast("array<struct<event_type bigint, value double>>"))
    node = _node(node_id=_named(p["node_id"]), packet_node_id=p["node_id"], module_id=p["module_id"])
    return _update(node, fill(FEATURES, packet_type=F.lit("wasm_event"), raw_bytes=size, module_id=p["module_id"], events=events), _absent(), fill(VITALS), F.lit(0))


def generic_update(size: Column) -> list[Column]:
    """Columns of the update of any other packet: its size, and nobody there."""
    none = F.array().cast(NODE)
    return _update(none, fill(FEATURES, packet_type=F.lit("unknown"), raw_bytes=size), _absent(), fill(VITALS), F.lit(0))


def raw_csi_update(p: Column, size: Column) -> list[Column]:
    """Columns of the update of a raw frame whose history statistics and scores are columns of the row."""
    present = F.coalesce(F.col("state") != "empty", F.lit(False))
    level = F.coalesce(*[F.when(F.col("state") == s, F.lit(v)) for s, v in LEVELS.items()])
    node = _node(
        node_id=_named(p["node_id"]), rssi_dbm=F.col("mean_rssi"), amplitude=F.col("cells"), subcarrier_count=F.size("cells"), packet_node_id=p["node_id"],
        frequency_band=p["band"], bandwidth_mhz=p["bandwidth_mhz"], sequence_number=p["sequence"], noise_floor_dbm=p["noise_floor_dbm"], ppdu_type=p["ppdu_type"], sync_valid=p["sync_valid"],
    )
    features = fill(
        FEATURES, packet_type=F.lit("raw_csi"), raw_bytes=size, mean_rssi=F.col("mean_rssi"), variance=F.col("amplitude_variance"), mean_amplitude=F.col("mean_amplitude"),
        temporal_delta=F.col("temporal_delta"), phase_variance=F.col("phase_variance"), subcarrier_variance=F.col("subcarrier_variance"), motion_energy=F.col("motion_energy"),
        motion_band_power=F.col("delta_component"), breathing_band_power=F.col("phase_variance"), motion_score=F.col("motion_score"), change_points=F.col("change_points"),
        frame_count=F.col("frame_count"), frequency_mhz=p["frequency_mhz"], sequence_number=p["sequence"],
    )
    classes = fill(
        CLASSIFICATION, motion_level=level, presence=present, confidence=F.col("presence_score"), state=F.col("state"), moving=F.col("state") == "moving",
        presence_score=F.col("presence_score"), motion_score=F.col("motion_score"),
    )
    return _update(node, features, classes, fill(VITALS), present.cast("int"))


def to_updates(decoded: DataFrame, order: Sequence[str], source: str = "esp32", packet: str = "packet", history: int = HISTORY) -> DataFrame:
    """One update per row of decoded packets (see ``packets.decode``): ``order``, source, error and the update's columns.

    ``order`` is unique and not null; it gives the order of a node's frames, over whose last ``history``
    a raw frame is judged, and the tick is its first column. Sync, event and vitals packets are
    judged by themselves. Rows that do not decode are generic updates with their error.
    """
    order = list(order)
    size = F.length(packet)
    rows = decoded.withColumn("_bytes", size)
    head = [*order, F.lit(source).alias("source"), F.col(order[0]).alias("tick"), "error"]

    is_raw = F.coalesce((F.col("family") == "raw_csi") & F.col("error").isNull(), F.lit(False))
    known = {"edge_vitals": edge_vitals_update, "sync": sync_update, "wasm_event": wasm_event_update}
    choices = {family: columns(F.col(family), F.col("_bytes")) for family, columns in known.items()}
    single = [
        F.coalesce(*[F.when(F.col(family).isNotNull(), columns[i]) for family, columns in choices.items()], other).alias(name)
        for i, (name, other) in enumerate(zip(COLUMNS, generic_update(F.col("_bytes"))))
    ]
    raw = rows.where(is_raw)
    p = F.col("raw_csi")
    frames = raw.select(
        p["node_id"].alias("node_id"), *order, F.struct(*[p[f].alias(f) for f in decoded.schema["raw_csi"].dataType.names if f not in ("iq", "trailing")]).alias("raw_csi"),
        "_bytes", "error", p["rssi_dbm"].cast("double").alias("rssi"), p["antennas"].cast("int").alias("antennas"),
        F.transform(p["iq"], lambda z: F.hypot(z["re"], z["im"])).alias("amplitude"), F.transform(p["iq"], lambda z: F.atan2(z["im"], z["re"])).alias("phase"),
    )
    seq = seqs.sequence(frames, ["node_id"], order)
    judged = win.score_windows(frame_history(seq, ["node_id"], [*order, "raw_csi", "_bytes", "error"], history))
    return judged.select(*head, *raw_csi_update(F.col("raw_csi"), F.col("_bytes"))).unionByName(rows.where(~is_raw).select(*head, *single))
