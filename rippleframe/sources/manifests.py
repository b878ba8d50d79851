"""Small JSON documents: calibration baselines, checkpoints and model exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.sources.hashing import blake3

BASELINE = "subcarrier int, amplitude_mean double, amplitude_variance double, phase_mean double, phase_dispersion double, frames long, version int"
CHECKPOINT = "format string, schema_version int, epoch long, metrics map<string,double>, config map<string,string>, weights_path string, provenance map<string,string>"
TENSORS = "array<struct<name:string,shape:array<long>,dtype:string,layout:string>>"
EXPORT = f"model_name string, inputs {TENSORS}, outputs {TENSORS}, backend string, weights_path string, weights_hash string, schema_version int"


def write(df: DataFrame, path: str) -> None:
    """One JSON document per line, without null fields."""
    df.write.mode("errorifexists").json(path)


def read(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): lines that do not parse keep their text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = spark.read.text(path).filter(F.trim("value") != "")
    rows = rows.withColumn("_r", F.from_json("value", f"{schema}, _corrupt string", options))
    good = rows.filter("_r._corrupt IS NULL").select("_r.*").drop("_corrupt")
    return good, rows.filter("_r._corrupt IS NOT NULL").select("value")


def tensor_shapes(exports: DataFrame) -> DataFrame:
    """Model tensors by direction."""
    side = lambda name: exports.select("model_name", F.lit(name).alias("direction"), F.explode(name).alias("t"))
    return side("inputs").unionByName(side("outputs")).select("model_name", "direction", "t.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """BLAKE3 of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.lower(F.hex(blake3("content"))).alias("digest"))
