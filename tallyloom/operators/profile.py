"""Column profiles: shape, types, numeric and categorical summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.quantiles import QUARTILES, moments, quantiles
from tallyloom.operators.reshape import to_long


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and of columns."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns")
    )


def columns_but(df: DataFrame, *left_out: str) -> list[str]:
    """All column names except the given ones, in order."""
    return [c for c in df.columns if c not in left_out]


def first_columns(df: DataFrame, n: int) -> DataFrame:
    """The leftmost ``n`` columns."""
    return df.select(df.columns[:n])


def info(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of every column, from one aggregate."""
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.col(f"n{i}").alias("non_null"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


DESCRIBED = (
    "column string, count bigint, mean double, std double, min double, "
    "p25 double, p50 double, p75 double, max double"
)


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, range and exact interpolated quartiles per column.

    NaN counts as missing. The source is scanned twice. Only the figures of each column, one row
    apiece, pass through the driver.
    """
    found = moments(df, columns)
    cuts = quantiles(df, found, QUARTILES)
    rows = [
        (c, m["count"], m["mean"], m["std"], m["min"], *cuts[c], m["max"])
        for c, m in found.items()
    ]
    return df.sparkSession.createDataFrame(rows, DESCRIBED)


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its count per column.

    Of several equally frequent values the smallest (as text) is taken. A column without any
    value has count 0.
    """
    long = to_long(df, [], columns, variable="column", as_type="string")
    counted = long.where("value IS NOT NULL").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    found = counted.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )
    return every_column(found, columns, "count", "unique")


def every_column(found: DataFrame, columns: Sequence[str], *counts: str) -> DataFrame:
    """A row for each of the columns, its counts 0 where nothing was found."""
    names = found.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts}
    )


def describe_timestamp(df: DataFrame, column: str) -> DataFrame:
    """The categorical summary of a timestamp column with its first and last value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("top"),
        F.max("n").alias("freq"),
        F.min(column).alias("first"),
        F.max(column).alias("last"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct non-null values of each column, 0 if there is none, in long form."""
    counted = (
        to_long(df, [], columns, variable="column", as_type="string")
        .where("value IS NOT NULL")
        .distinct()
    )
    found = counted.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return every_column(found, columns, "n_distinct")
