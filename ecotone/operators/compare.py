"""Comparing two rasters, and checking one against an independent sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairwise(old: DataFrame, new: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """A row for each band: valid in old, in new, in both, in one only; mean of new less old and largest absolute difference where both are."""
    both = old.select(*keys, *(F.col(b).alias(f"o_{b}") for b in bands)).join(new.select(*keys, *(F.col(b).alias(f"n_{b}") for b in bands)), keys, "full_outer")
    long = both.select(F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"o_{b}").cast("double").alias("o"), F.col(f"n_{b}").cast("double").alias("n")) for b in bands))))
    d = F.col("n") - F.col("o")
    return long.groupBy("band").agg(F.count("o").alias("old_valid"), F.count("n").alias("new_valid"), F.count(d).alias("both_valid"), F.count_if(F.col("o").isNull() != F.col("n").isNull()).alias("mask_mismatch"), F.avg(d).alias("mean_difference"), F.max(F.abs(d)).alias("max_difference"))


def complete_case(old: DataFrame, new: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """As pairwise, over the cells where all bands of both are valid; old_cells and new_cells count complete cells of either."""
    whole = lambda p: " AND ".join(f"{p}_{b} IS NOT NULL" for b in bands)
    both = old.select(*keys, *(F.col(b).alias(f"o_{b}") for b in bands)).join(new.select(*keys, *(F.col(b).alias(f"n_{b}") for b in bands)), keys, "full_outer")
    marked = both.withColumns({"_o": F.expr(whole("o")), "_n": F.expr(whole("n"))})
    diff = lambda b: F.when(F.col("_o") & F.col("_n"), (F.col(f"n_{b}") - F.col(f"o_{b}")).cast("double"))
    return marked.agg(F.count_if("_o").alias("old_cells"), F.count_if("_n").alias("new_cells"), F.count_if(F.col("_o") & F.col("_n")).alias("both_cells"), *(F.avg(diff(b)).alias(f"{b}_mean_difference") for b in bands), *(F.max(F.abs(diff(b))).alias(f"{b}_max_difference") for b in bands))


def stratified(df: DataFrame, stratum: str, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows of each stratum, chosen by a hash of the keys and the seed; nothing is sorted beyond the chosen."""
    from pyspark.sql import Window

    mark = F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))), 256)
    order = Window.partitionBy(stratum).orderBy("_mark", *keys)
    return df.withColumn("_mark", mark).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_mark", "_r")


def within(sample: DataFrame, recomputed: DataFrame, bands: dict[str, float], keys: list[str]) -> DataFrame:
    """A row for each band: cells compared, largest difference, whether it is within the band's tolerance."""
    both = sample.select(*keys, *bands).join(recomputed.select(*keys, *(F.col(b).alias(f"r_{b}") for b in bands)), keys)
    long = both.select(F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.abs(F.col(b) - F.col(f"r_{b}")).alias("d"), F.lit(t).alias("tolerance")) for b, t in bands.items()))))
    return long.groupBy("band", "tolerance").agg(F.count("d").alias("cells"), F.max("d").alias("largest")).withColumn("passes", F.coalesce(F.col("largest") <= F.col("tolerance"), F.lit(True)))
