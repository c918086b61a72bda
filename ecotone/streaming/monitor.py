"""Task status as it arrives: the latest state of each task, and counts by state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "task_id STRING, description STRING, state STRING, updated TIMESTAMP"


def status_stream(spark: SparkSession, path: str) -> DataFrame:
    """Status lines (JSON) that processes append to a folder."""
    return spark.readStream.schema(STATUS).json(path)


def latest_states(events: DataFrame) -> DataFrame:
    """(task_id, state): that of the last update; works on a stream (update or complete mode) and on a table."""
    return events.groupBy("task_id").agg(F.max_by("state", F.struct("updated", "state")).alias("state"))


def new_updates(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each update once, though a poll repeats it, with bounded state."""
    return events.withWatermark("updated", late).dropDuplicatesWithinWatermark(["task_id", "state"])


def state_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Updates by time window and state."""
    return events.withWatermark("updated", late).groupBy(F.window("updated", window), "state").agg(F.count(F.lit(1)).alias("n"))
