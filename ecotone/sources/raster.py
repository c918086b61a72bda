"""Raster layouts: a row for each cell, or a row for each block of cells."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lattice(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """A stored lattice, only the bands asked for."""
    df = spark.read.parquet(path)
    keys = [c for c in ("tile_id", "image_id", "row_idx", "col_idx") if c in df.columns]
    return df.select(*keys, *(bands or [c for c in df.columns if c not in keys]))


def window(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of an index rectangle, first included and last not: a predicate that Parquet statistics prune by."""
    return df.where(F.col("row_idx").between(rows[0], rows[1] - 1) & F.col("col_idx").between(cols[0], cols[1] - 1))


def write_lattice(df: DataFrame, path: str, metadata: dict, block: int = 1024, mode: str = "errorifexists") -> None:
    """Write a lattice partitioned by blocks of rows, sorted so that statistics prune, with its metadata beside it."""
    keyed = df.withColumn("block_row", F.floor(F.col("row_idx") / block))
    keyed.repartition("block_row").sortWithinPartitions("row_idx", "col_idx").write.partitionBy("block_row").mode(mode).parquet(path)
    text = json.dumps(metadata, sort_keys=True, separators=(",", ":"))
    df.sparkSession.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode(mode).text(f"{path}.metadata")


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.metadata").head()[0])


def to_blocks(df: DataFrame, bands: list[str], block: int = 256) -> DataFrame:
    """(block_row, block_col, cells): cells as an array of (row_idx, col_idx, bands), row by row."""
    cell = F.struct("row_idx", "col_idx", *bands)
    return df.groupBy(F.floor(F.col("row_idx") / block).alias("block_row"), F.floor(F.col("col_idx") / block).alias("block_col")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.inline("cells"))


def dense(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Every position of an index rectangle as a row; cells that df lacks have null bands."""
    spark, width = df.sparkSession, cols[1] - cols[0]
    every = spark.range((rows[1] - rows[0]) * width).select((F.floor(F.col("id") / width) + rows[0]).alias("row_idx"), (F.col("id") % width + cols[0]).alias("col_idx"))
    return every.join(df, ["row_idx", "col_idx"], "left")


def probe(df: DataFrame) -> list[dict]:
    """Names and types of the bands."""
    return [{"id": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
