"""Grids as integers.

A grid is an EPSG:4326 affine transform anchored at (-180, 90); data carry row
and column numbers, so joins and regridding need no floating point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres.
EARTH_RADIUS = 6371008.8


@dataclass(frozen=True)
class Grid:
    """Cell size as a fraction of a degree: `step` / `per`."""

    name: str
    step: int
    per: int
    crs: str = "EPSG:4326"

    @property
    def size(self) -> float:
        return self.step / self.per

    @property
    def transform(self) -> list[float]:
        return [self.size, 0, -180, 0, -self.size, 90]

    def latitude(self, row: Column) -> Column:
        """Latitude of a cell's centre."""
        return F.lit(90.0) - (row + 0.5) * self.size

    def longitude(self, col: Column) -> Column:
        return F.lit(-180.0) + (col + 0.5) * self.size

    def area(self, row: Column) -> Column:
        """Square metres of a cell on a sphere, by the cosine of its centre's latitude."""
        side = EARTH_RADIUS * 0.017453292519943295 * self.size
        return F.lit(side * side) * F.cos(F.radians(self.latitude(row)))

    def index_range(self, low: float, high: float, axis: str) -> tuple[int, int]:
        """Row or column numbers, first and one past the last, of the cells whose centres lie in [low, high)."""
        from math import ceil

        if axis == "col":
            return ceil((low + 180) / self.size - 0.5), ceil((high + 180) / self.size - 0.5)
        return ceil((90 - high) / self.size - 0.5), ceil((90 - low) / self.size - 0.5)


#: The 30 m grid and the 30 arc-second climate grid.
FINE = Grid("fine", 1, 4000)
CLIMATE = Grid("climate", 1, 120)

#: Fine cells are three units wide, climate cells a hundred.
FINE_UNITS, CLIMATE_UNITS = 3, 100


def overlap_cells(index: Column) -> tuple[Column, Column]:
    """First and last climate cell that a fine cell touches on one axis."""
    return F.floor(index * FINE_UNITS / CLIMATE_UNITS).cast("long"), F.floor((index * FINE_UNITS + FINE_UNITS - 1) / CLIMATE_UNITS).cast("long")


def overlap_units(index: Column, cell: Column) -> Column:
    """Units that a fine cell and a climate cell have in common on one axis: 1, 2 or 3."""
    return F.least(index * FINE_UNITS + FINE_UNITS, cell * CLIMATE_UNITS + CLIMATE_UNITS) - F.greatest(index * FINE_UNITS, cell * CLIMATE_UNITS)


def nearest_cell(index: Column) -> Column:
    """The climate cell that holds a fine cell's centre."""
    return F.floor((index * 2 + 1) * FINE_UNITS / (2 * CLIMATE_UNITS)).cast("long")


def coordinate_label(value: Column, positive: str, negative: str, digits: int) -> Column:
    """N05, W170: zero takes the positive letter."""
    return F.concat(F.when(value >= 0, positive).otherwise(negative), F.lpad(F.abs(value).cast("int").cast("string"), digits, "0"))


def tile_id(min_lat: Column, min_lon: Column) -> Column:
    return F.concat(coordinate_label(min_lat, "N", "S", 2), F.lit("_"), coordinate_label(min_lon, "E", "W", 3))
