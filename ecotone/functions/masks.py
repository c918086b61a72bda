"""Masks are NULLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def self_mask(x: Column) -> Column:
    """x where it is not zero."""
    return F.when(x != 0, x)


def update_mask(x: Column, mask: Column) -> Column:
    """x where the mask is neither null nor zero."""
    return F.when(mask.cast("int") != 0, x)


def unmask(x: Column, value) -> Column:
    return F.coalesce(x, F.lit(value))


def both(a: Column, b: Column) -> Column:
    """1 or 0, null where either operand is: unlike SQL, false and null is null."""
    return F.when(a.isNotNull() & b.isNotNull(), ((a != 0) & (b != 0)).cast("int"))


def either(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), ((a != 0) | (b != 0)).cast("int"))


def invert(a: Column) -> Column:
    return F.when(a.isNotNull(), (a == 0).cast("int"))


def above(x: Column, limit: float) -> Column:
    """1 where x exceeds the limit strictly; a NaN is masked."""
    return F.when(~F.isnan(x), (x > limit).cast("int"))


def class_mask(x: Column, classes) -> Column:
    return F.when(x.isNotNull(), x.isin(*classes).cast("int"))


def replaced(default, *cases: tuple[Column, object]) -> Column:
    """A chain of conditional replacements: the last that holds wins."""
    return reduce(lambda out, case: F.when(case[0], F.lit(case[1])).otherwise(out), cases, F.lit(default))


def common_mask(*bands: Column) -> Column:
    """1 where every band is valid, else 0."""
    return F.least(*(b.isNotNull().cast("int") for b in bands)) if len(bands) > 1 else bands[0].isNotNull().cast("int")
