"""Manifests, registries and receipts: JSON in, JSON out, with the rules they must meet."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layouts of the documents.
TILES = "tile_id STRING, bbox ARRAY<DOUBLE>, min_lon DOUBLE, max_lon DOUBLE, min_lat DOUBLE, max_lat DOUBLE"
TASK = "mountain_id STRING, mountain_key STRING, product STRING, destination STRING, configuration_hash STRING, state STRING, task_id STRING, id STRING, attempt_count INT, attempt INT, error_message STRING, error STRING"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The tiles of a manifest, a row each; duplicate or missing ids and bad boxes are an error."""
    tile = "struct<" + ",".join(f"{c.strip().split(' ')[0]}:{c.strip().split(' ')[1]}" for c in TILES.split(", ")) + ">"
    raw = spark.read.schema(f"configuration_hash STRING, tiles ARRAY<{tile}>").json(path, multiLine=True)
    tiles = raw.select("configuration_hash", F.inline("tiles"))
    check = tiles.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tile_id").alias("ids"), F.count_if(F.coalesce(F.size("bbox"), F.lit(0)) != 4).alias("boxes")).head()
    if not check["n"]:
        raise ValueError("the manifest has no tiles")
    if check["ids"] != check["n"]:
        raise ValueError("tile ids are missing or not unique")
    if check["boxes"]:
        raise ValueError("a tile's box has not four numbers")
    return tiles


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a registry, a row each, with the registry's hash; more than one hash is an error."""
    task = "struct<" + ",".join(c.strip().replace(" ", ":") for c in TASK.split(", ")) + ">"
    raw = spark.read.schema(f"project STRING, configuration_hash STRING, tasks ARRAY<{task}>").json(path, multiLine=True)
    tasks = raw.select("project", F.col("configuration_hash").alias("registry_hash"), F.inline("tasks"))
    if tasks.where("configuration_hash IS NOT NULL AND configuration_hash <> registry_hash").limit(1).count():
        raise ValueError("the registry mixes configuration hashes")
    return tasks


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Fixed thresholds (mountain_key, threshold_c) from CSV: finite, one for each mountain."""
    df = spark.read.schema("mountain_key STRING, threshold_c DOUBLE").csv(path, header=True)
    bad = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mountain_key").alias("keys"), F.count_if(F.col("threshold_c").isNull() | F.isnan("threshold_c") | (F.abs("threshold_c") == float("inf"))).alias("odd")).head()
    if bad["n"] != bad["keys"] or bad["odd"]:
        raise ValueError("thresholds must be finite, one for each mountain")
    return df


def write_json(path: str, value) -> None:
    """Write all of a small document or nothing."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)


def write_new_json(path: str, value, never: str | None = None) -> None:
    """As write_json, but never over an existing file, nor over the path `never`."""
    if never and os.path.abspath(path) == os.path.abspath(never):
        raise ValueError("a report must not replace its source")
    if os.path.exists(path):
        raise FileExistsError(path)
    write_json(path, value)


def list_assets(spark: SparkSession, parent: str) -> list[str]:
    """Names below a folder, in order, in any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def asset_exists(spark: SparkSession, name: str) -> bool:
    """Whether a path exists; errors other than its absence are raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))
