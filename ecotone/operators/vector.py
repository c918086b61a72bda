"""Tiles, boxes and polygons.

A polygon is a row with `rings`: an array of rings, each an array of (x, y).
Spatial joins first meet in cells of a coarse square raster, so they are equi
joins that shuffle by cell, and only then test boxes or rings exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ecotone.functions.grid import EARTH_RADIUS, Grid, tile_id

#: Degrees of a tile's side, and of the raster that spatial joins meet in.
TILE = 10
CELL = 5.0


def regular_tiles(spark: SparkSession, lat_min: int = -60, lat_max: int = 80) -> DataFrame:
    """Tiles of ten degrees, by latitude, then longitude."""
    if lat_min % TILE or lat_max % TILE or not -90 <= lat_min < lat_max <= 90:
        raise ValueError("latitudes must be multiples of ten within -90..90, the smaller first")
    across = 360 // TILE
    n = spark.range((lat_max - lat_min) // TILE * across).withColumns({"min_lat": (F.floor(F.col("id") / across) * TILE + lat_min).cast("double"), "min_lon": (F.col("id") % across * TILE - 180).cast("double")})
    return n.select(tile_id(F.col("min_lat"), F.col("min_lon")).alias("tile_id"), "min_lon", (F.col("min_lon") + TILE).alias("max_lon"), "min_lat", (F.col("min_lat") + TILE).alias("max_lat"))


def box_cells(df: DataFrame, size: float = CELL, names: tuple = ("min_lon", "max_lon", "min_lat", "max_lat")) -> DataFrame:
    """df once for each raster cell that its box touches."""
    x0, x1, y0, y1 = (F.floor(F.col(n) / size).cast("int") for n in names)
    return df.withColumn("_cx", F.explode(F.sequence(x0, x1))).withColumn("_cy", F.explode(F.sequence(y0, y1)))


def box_pairs(left: DataFrame, right: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs (l, r) of ids of boxes that touch; both have id, min_lon, max_lon, min_lat, max_lat.

    A pair that shares several cells is kept in the one that holds the lower
    left corner of the common part, so no distinct is needed.
    """
    a, b = box_cells(left, size).alias("a"), box_cells(right, size).alias("b")
    touch = (F.col("a.min_lon") <= F.col("b.max_lon")) & (F.col("a.max_lon") >= F.col("b.min_lon")) & (F.col("a.min_lat") <= F.col("b.max_lat")) & (F.col("a.max_lat") >= F.col("b.min_lat"))
    first = (F.floor(F.greatest("a.min_lon", "b.min_lon") / size) == F.col("a._cx")) & (F.floor(F.greatest("a.min_lat", "b.min_lat") / size) == F.col("a._cy"))
    return a.join(b, (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & touch & first).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"))


def touched(tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """The tiles that at least one box touches."""
    return tiles.join(box_pairs(tiles.withColumn("id", F.col("tile_id")), boxes).select(F.col("l").alias("tile_id")), "tile_id", "left_semi")


def tile_counts(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """boxes with the number of tiles that each touches, 0 kept."""
    n = box_pairs(boxes, tiles.withColumn("id", F.col("tile_id"))).groupBy(F.col("l").alias("id")).agg(F.count(F.lit(1)).alias("required_tiles"))
    return boxes.join(n, "id", "left").withColumn("required_tiles", F.coalesce("required_tiles", F.lit(0)))


def bounds(rings: Column) -> list[Column]:
    """min_lon, max_lon, min_lat, max_lat of a polygon."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(xs).alias("min_lon"), F.array_max(xs).alias("max_lon"), F.array_min(ys).alias("min_lat"), F.array_max(ys).alias("max_lat")]


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is within an odd number of rings, by the crossings of a ray to the right."""
    crossings = []
    flat = F.transform(rings, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    sides = F.flatten(flat)
    crosses = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < s["a"]["x"] + (y - s["a"]["y"]) * F.try_divide(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))
    crossings.append(F.size(F.filter(sides, lambda s: F.coalesce(crosses(s), F.lit(False)))))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1


def rasterized(cells: DataFrame, polygons: DataFrame, grid: Grid, size: float = CELL) -> DataFrame:
    """(cells' columns, polygon id): each cell whose centre lies in a polygon (id, rings)."""
    c = cells.withColumns({"_x": grid.longitude(F.col("col_idx")), "_y": grid.latitude(F.col("row_idx"))}).withColumns({"_cx": F.floor(F.col("_x") / size).cast("int"), "_cy": F.floor(F.col("_y") / size).cast("int")})
    p = box_cells(polygons.select(F.col("id").alias("polygon_id"), "rings", *bounds(F.col("rings"))), size)
    near = c.join(p, ["_cx", "_cy"]).where(F.col("_x").between(F.col("min_lon"), F.col("max_lon")) & F.col("_y").between(F.col("min_lat"), F.col("max_lat")))
    return near.where(inside(F.col("rings"), F.col("_x"), F.col("_y"))).select(*cells.columns, "polygon_id")


def planar_area(rings: Column) -> Column:
    """Unsigned shoelace area in square degrees; rings wound the other way are holes."""
    cross = lambda r: F.aggregate(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda t, v: t + v) / 2
    return F.abs(F.aggregate(F.transform(rings, cross), F.lit(0.0), lambda t, v: t + v))


def box_area_km2(min_lon: Column, max_lon: Column, min_lat: Column, max_lat: Column) -> Column:
    """Area of a box on a sphere."""
    return F.lit(EARTH_RADIUS**2 / 1e6) * F.radians(max_lon - min_lon) * (F.sin(F.radians(max_lat)) - F.sin(F.radians(min_lat)))


def geometry_metrics(boxes: DataFrame, tiles: DataFrame, area: str) -> DataFrame:
    """boxes with bounds_area_km2, its ratio to `area` (null unless that is positive) and required_tiles."""
    whole = box_area_km2(*(F.col(n) for n in ("min_lon", "max_lon", "min_lat", "max_lat")))
    return tile_counts(boxes, tiles).withColumn("bounds_area_km2", whole).withColumn("bounds_ratio", F.when(F.col(area) > 0, F.col("bounds_area_km2") / F.col(area)))


def latitude_diagnostics(boxes: DataFrame, tiles: DataFrame, lat_min: float, lat_max: float, listed: DataFrame) -> DataFrame:
    """One row: boxes beyond the latitudes, how many of them `listed` (id) names, tiles beyond that they touch, and whether the range must widen."""
    out = boxes.where((F.col("max_lat") > lat_max) | (F.col("min_lat") < lat_min))
    got = out.join(listed.select("id", F.lit(1).alias("_in")).distinct(), "id", "left").agg(F.count(F.lit(1)).alias("outside"), F.count("_in").alias("outside_listed"))
    beyond = touched(tiles.where((F.col("max_lat") > lat_max) | (F.col("min_lat") < lat_min)), out).agg(F.count(F.lit(1)).alias("outside_tiles"))
    return got.join(beyond).withColumn("requires_extension", (F.col("outside_listed") > 0) | (F.col("outside_tiles") > 0))
