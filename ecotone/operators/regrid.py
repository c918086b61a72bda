"""From the fine grid to the climate grid: area-weighted means, any-cell maxima, nearest cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecotone.functions.grid import nearest_cell, overlap_cells, overlap_units

#: Years between the two epochs.
YEARS = 20


def overlaps(df: DataFrame) -> DataFrame:
    """A row for each fine cell and climate cell that overlap, with the climate cell and their common area in ninths of a fine cell."""
    for axis, out in (("row_idx", "crow"), ("col_idx", "ccol")):
        low, high = overlap_cells(F.col(axis))
        df = df.withColumn(out, F.explode(F.sequence(low, high)))
    return df.withColumn("weight", overlap_units(F.col("row_idx"), F.col("crow")) * overlap_units(F.col("col_idx"), F.col("ccol")))


def mean(df: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """Weighted means per climate cell, all bands in one pass; null cells count for neither sum, a band without any is null."""
    keys = keys or []
    got = overlaps(df.select(*keys, "row_idx", "col_idx", *bands)).groupBy(*keys, "crow", "ccol")
    return got.agg(*(F.try_divide(F.sum(F.col(b).cast("double") * F.col("weight")), F.sum(F.when(F.col(b).isNotNull(), F.col("weight")))).alias(b) for b in bands))


def any_cell(df: DataFrame, band: str, keys: list[str] | None = None) -> DataFrame:
    """(crow, ccol): the climate cells that touch a fine cell whose band is above 0, once each."""
    keys = keys or []
    return overlaps(df.where(F.col(band) > 0).select(*keys, "row_idx", "col_idx")).select(*keys, "crow", "ccol").distinct()


def with_nearest(df: DataFrame) -> DataFrame:
    """df with the climate cell of each fine cell's centre."""
    return df.withColumns({"crow": nearest_cell(F.col("row_idx")), "ccol": nearest_cell(F.col("col_idx"))})


def treeline_shift(df: DataFrame, labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """Means of treeline_<year>_<label>_m and the yearly shift between them, null unless both are there."""
    bands = [f"treeline_{y}_{x}_m" for x in labels for y in (2000, 2020)]
    means = mean(df, bands, keys)
    out = []
    for x in labels:
        early, late = F.col(f"treeline_2000_{x}_m"), F.col(f"treeline_2020_{x}_m")
        out += [early.alias(f"treeline_2000_{x}_mean_m"), late.alias(f"treeline_2020_{x}_mean_m"), ((late - early) / YEARS).alias(f"shift_2000_2020_{x}_m_per_year")]
    return means.select(*(keys or []), "crow", "ccol", *out)


def overlap_means(df: DataFrame, bands: list[str], lon: str = "lon", lat: str = "lat", cell: tuple = (0.0, 0.0, 0.0003, 0.00025), pixel: float = 0.00025) -> DataFrame:
    """Weighted means over one box from cell centres in degrees, the independent check of `mean`; a band without weight is null."""
    x0, y0, x1, y1 = cell
    wide = F.least(F.col(lon) + pixel / 2, F.lit(x1)) - F.greatest(F.col(lon) - pixel / 2, F.lit(x0))
    high = F.least(F.col(lat) + pixel / 2, F.lit(y1)) - F.greatest(F.col(lat) - pixel / 2, F.lit(y0))
    weight = F.least(F.lit(1.0), F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0)) / (pixel * pixel))
    got = df.withColumn("_w", weight).where("_w > 0")
    return got.agg(F.count(F.lit(1)).alias("overlaps"), *(F.sum(F.when(F.col(b).isNotNull(), F.col("_w"))).alias(f"{b}_weight") for b in bands), *(F.try_divide(F.sum(F.col(b) * F.col("_w")), F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))).alias(b) for b in bands))
