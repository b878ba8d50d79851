"""JSON-lines recordings to sensing updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.functions import scoring as sc
from rippleframe.functions import vectors as vec

# Amplitude aliases in order of precedence; training reads ``csi`` first.
AMPLITUDE_KEYS = ["subcarriers", "amplitude", "amplitudes", "values", "csi"]
TRAINING_KEYS = ["csi", "subcarriers", "amplitude", "amplitudes", "values"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Recording lines in file order, without blank and comment lines."""
    return records(spark.read.text(path), "value")


def records(df: DataFrame, line: str) -> DataFrame:
    text = F.trim(F.col(line))
    return df.filter((text != "") & ~text.startswith("#"))


# Every alias a record may use; scalars are read as text and cast.
_AMP = ", ".join(f"`{k}` array<double>" for k in AMPLITUDE_KEYS)
RECORD = (
    f"type string, tick string, source string, nodes array<struct<node_id:string,rssi_dbm:string>>, features string, "
    f"classification struct<presence:string,motion_level:string>, signal_field string, {_AMP}, presence string, "
    f"node_id string, id string, rssi_dbm string, rssi string, _corrupt string"
)


def parse(line: Column) -> Column:
    """The record as one struct, read in a single pass; ``_corrupt`` keeps unreadable lines."""
    return F.from_json(line, RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def amplitude(record: Column, keys: list[str] = AMPLITUDE_KEYS) -> Column:
    """First alias that is present; an empty array when there is none."""
    return F.coalesce(*[record[k] for k in keys], F.array().cast("array<double>"))


def count_change_points(values: Column) -> Column:
    """Steps above mean + 2 deviations within one array of at least three values."""
    step = F.transform(
        F.sequence(F.lit(2), F.size(values)), lambda i: F.abs(F.element_at(values, i) - F.element_at(values, i - 1))
    )
    over = vec.let(
        step,
        lambda d: vec.let(vec.mean(d) + 2 * F.sqrt(vec.var_pop(d)), lambda t: F.size(F.filter(d, lambda x: x > t))),
    )
    return F.when(F.size(values) >= 3, over).otherwise(F.lit(0))


def to_updates(df: DataFrame, line: str, tick: Column, source: str = "replay") -> DataFrame:
    """Normalise recording rows. Full updates keep their own tick and node; short
    records get the derived score, presence and motion level."""
    r = F.col("_r")
    rows = df.withColumn("_r", parse(F.col(line))).withColumn("_tick", tick)
    rows = rows.withColumn("_amp", amplitude(r))
    n = F.size("_amp")
    rows = rows.withColumn("mean_amplitude", F.when(n > 0, vec.mean("_amp")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("variance", F.when(n > 0, vec.var_pop("_amp")).otherwise(F.lit(0.0)))
    parts = [r[k].isNotNull() for k in ("nodes", "features", "classification", "signal_field")]
    whole = parts[0] & parts[1] & parts[2] & parts[3]
    rows = rows.withColumn("is_update", F.coalesce(r["type"] == "sensing_update", F.lit(False)) | whole)
    rows = rows.withColumn("motion_score", sc.clamp01_or_zero(F.sqrt("variance") / (F.abs("mean_amplitude") + 1e-9)))
    said = F.coalesce(r["presence"], r["classification"]["presence"]).try_cast("boolean")
    rows = rows.withColumn("presence", F.coalesce(said, F.col("motion_score") > 0.04))
    level = F.coalesce(r["classification"]["motion_level"], sc.motion_level(F.col("motion_score"), F.col("presence")))
    first = F.get(r["nodes"], F.lit(0))
    number = lambda c: c.try_cast("double")
    return rows.select(
        *[c for c in df.columns if c != line],
        F.lit(source).alias("source"),
        F.coalesce(F.when(F.col("is_update"), number(r["tick"]).cast("bigint")), F.col("_tick")).alias("tick"),
        F.coalesce(F.when(F.col("is_update"), first["node_id"]), r["node_id"], r["id"], F.lit("replay-node-1")).alias("node_id"),
        F.coalesce(number(r["rssi_dbm"]), number(r["rssi"]), number(first["rssi_dbm"]), F.lit(0.0)).alias("rssi_dbm"),
        n.alias("subcarrier_count"), "mean_amplitude", "variance", "motion_score", "presence", level.alias("motion_level"),
        F.when(F.col("presence"), F.col("motion_score")).otherwise(1.0 - F.col("motion_score")).alias("confidence"),
        count_change_points(F.col("_amp")).alias("change_points"),
        F.when(r["_corrupt"].isNotNull(), F.lit("not a JSON object")).alias("error"),
    )
