"""Click-through arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_click(click: str) -> Column:
    return F.col(click).cast("boolean")


def clicks(click: str = "click") -> Column:
    return F.count_if(is_click(click))


def impressions(click: str = "click") -> Column:
    return F.count(F.col(click))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; null when ``whole`` is 0."""
    return F.try_divide(F.lit(100.0) * part, whole)
