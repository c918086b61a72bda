"""Scalar functions on names, identifiers, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(raw: Column, scale: float, offset: float) -> Column:
    """raw * scale + offset, as for deci-Kelvin to degrees Celsius."""
    return raw * F.lit(scale) + F.lit(offset)


def id_text(number: Column) -> Column:
    """A numeric id as digits without a fraction."""
    return F.round(number).cast("long").cast("string")


def safe_name(text: Column) -> Column:
    """Runs of characters other than letters, digits, _ and - become one _; none at the ends; null if nothing is left."""
    got = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(got != "", got)


def threshold_label(metres: Column) -> Column:
    """h3m, h0p5m."""
    text = F.when(metres == F.floor(metres), metres.cast("long").cast("string")).otherwise(metres.cast("string"))
    return F.concat(F.lit("h"), F.replace(text, F.lit("."), F.lit("p")), F.lit("m"))


def out_of_memory(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.contains(text, F.lit("out of memory")) | F.contains(text, F.lit("memory limit"))


#: The categories of failed tasks, in report order.
FAILURE_CATEGORIES = ("treeline1km_oom_with_completed_treeline30m", "treeline1km_oom_without_completed_treeline30m", "treeline30m_oom", "qa30m_oom", "other_error")


def failure_category(product: Column, state: Column, message: Column, source_completed: Column) -> Column:
    """The category of a failed task; null for any other."""
    full = out_of_memory(message)
    one_km = (product == "treeline1km") & full
    return F.when(
        state == "FAILED",
        F.when(one_km & source_completed, FAILURE_CATEGORIES[0]).when(one_km, FAILURE_CATEGORIES[1])
        .when((product == "treeline30m") & full, FAILURE_CATEGORIES[2]).when((product == "qa30m") & full, FAILURE_CATEGORIES[3]).otherwise(FAILURE_CATEGORIES[4]),
    )


def numeric_order(text: Column) -> list[Column]:
    """Sort keys: numeric texts by value, the others after them by text."""
    return [F.expr(f"try_cast({_name(text)} AS BIGINT)").asc_nulls_last(), text.asc()]


def _name(column: Column) -> str:
    return column._jc.toString()


def compact_utc(moment: Column) -> Column:
    """20240131T235959Z, for file names."""
    return F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'")
