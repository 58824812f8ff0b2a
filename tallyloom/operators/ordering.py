"""Ranks over a whole result without putting it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.small import pin


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in the given order (a bounded heap per task, then one merge)."""
    return df.orderBy(*order).limit(n)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in ``order`` (which must have no ties).

    The rows are cut into ranges of the order; each range is numbered by itself and shifted by
    the size of the ranges before it, so no task sees more than its own range.
    """
    # The ranges come from sampling; writing them makes both uses below see the same ones.
    ranges = pin(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # One row per range, so as many as there are shuffle partitions.
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranges.withColumn("_inside", inside)
        .join(before, "_range")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_before")
    )
