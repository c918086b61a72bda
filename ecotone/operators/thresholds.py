"""Weighted histograms and thresholds per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most buckets, least samples, and the raw unit's scale and offset to degrees Celsius.
MAX_BUCKETS, MIN_SAMPLES = 256, 20
SCALE, OFFSET = 0.1, -273.15


def histogram(df: DataFrame, keys: list[str], value: str, weight: str | None = None, most: int = MAX_BUCKETS) -> DataFrame:
    """(keys, bucket, n, mean): buckets as wide as the smallest power of two that keeps a group within `most`; empty ones have no row."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), w.alias("_w"))
    # one pass to single units, which may be many, then to buckets: neither moves the input's rows
    units = df.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    span = units.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    fits = [((F.floor(F.col("_hi") / (1 << p)) - F.floor(F.col("_lo") / (1 << p)) + 1) <= most, 1 << p) for p in range(31)]
    width = F.when(*[fits[0][0], F.lit(fits[0][1])])
    for holds, size in fits[1:]:
        width = width.when(holds, F.lit(size))
    span = span.select(*keys, width.alias("_width"))
    got = units.join(span, keys).withColumn("bucket", F.floor(F.col("_v") / F.col("_width")) * F.col("_width"))
    return got.groupBy(*keys, "bucket").agg(F.sum("_w").alias("n"), (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("mean"))


def otsu(buckets: DataFrame, keys: list[str], least: float = MIN_SAMPLES, tie: str = "last", scale: float = SCALE, offset: float = OFFSET) -> DataFrame:
    """(keys, valid, threshold_raw, threshold_c, samples, buckets): the mean of the lower class's last bucket at the best split.

    Equal scores are frequent, as with empty buckets: the last split wins, or
    the first.  A split without samples on one side scores nothing.  A group
    with under two buckets with samples or too few samples is not valid.
    """
    order = Window.partitionBy(*keys).orderBy("bucket")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    b = buckets.withColumns({"_m": F.col("n") * F.col("mean")})
    b = b.withColumns({"_a": F.sum("n").over(upto), "_am": F.sum("_m").over(upto), "_t": F.sum("n").over(whole), "_tm": F.sum("_m").over(whole), "_k": F.row_number().over(order), "_size": F.count(F.lit(1)).over(whole)})
    g = F.try_divide("_tm", "_t")
    low, high = F.try_divide("_am", "_a"), F.try_divide(F.col("_tm") - F.col("_am"), F.col("_t") - F.col("_a"))
    score = F.col("_a") * (low - g) * (low - g) + (F.col("_t") - F.col("_a")) * (high - g) * (high - g)
    b = b.withColumn("_score", F.when((F.col("_k") < F.col("_size")) & (F.col("_a") > 0) & (F.col("_t") > F.col("_a")), F.round(score, 6)))
    place = F.col("_k") if tie == "last" else -F.col("_k")
    got = b.groupBy(*keys).agg(F.max_by(F.when(F.col("_score").isNotNull(), F.col("mean")), F.when(F.col("_score").isNotNull(), F.struct("_score", place.alias("p")))).alias("raw"), F.sum("n").alias("samples"), F.count(F.lit(1)).alias("buckets"), F.count_if(F.col("n") > 0).alias("_some"))
    valid = (F.col("buckets") >= 2) & (F.col("_some") >= 2) & (F.col("samples") >= least)
    return got.select(*keys, valid.cast("int").alias("valid"), F.when(valid, F.col("raw")).alias("threshold_raw"), F.when(valid, F.col("raw") * scale + offset).alias("threshold_c"), "samples", "buckets")


def fixed(table: DataFrame, scale: float = SCALE, offset: float = OFFSET) -> DataFrame:
    """Thresholds given in degrees, in the layout of `otsu`: always valid, counts -1."""
    return table.select("mountain_key", F.lit(1).alias("valid"), ((F.col("threshold_c") - offset) / scale).alias("threshold_raw"), "threshold_c", F.lit(-1.0).alias("samples"), F.lit(-1).cast("long").alias("buckets"))


def cold_zone(df: DataFrame, thresholds: DataFrame, keys: list[str], temperature: str) -> DataFrame:
    """df with `cold`: 1 at or below the group's threshold; 0 where the group has no valid one."""
    return df.join(thresholds.select(*keys, "valid", "threshold_c"), keys, "left").withColumn("cold", F.when(F.col(temperature).isNotNull(), F.coalesce((F.col("valid") == 1) & (F.col(temperature) <= F.col("threshold_c")), F.lit(False)).cast("int"))).drop("valid", "threshold_c")
