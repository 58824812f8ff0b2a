"""Threshold classes per column and set operations over the members of a class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import top_rows

MEAN = "mean"


def classify(
    df: DataFrame,
    thresholds: Mapping[str, float | str],
    low: str,
    high: str,
    names: Mapping[str, str] | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Add one class column per entry: below its threshold ``low``, else ``high``.

    A threshold is a number, or ``"mean"`` for the column's mean over all rows (any roll-up
    row included), cut to ``decimals`` places if given. A missing value is ``high``, because
    it is not below anything.
    """
    averaged = [c for c, t in thresholds.items() if t == MEAN]
    means = _means(df, averaged, decimals) if averaged else None
    added = {}
    for column, threshold in thresholds.items():
        limit = means[column] if threshold == MEAN else F.lit(float(threshold))
        name = (names or {}).get(column, f"class_{column}")
        added[name] = F.when(F.col(column) < limit, low).otherwise(high)
    return df.withColumns(added)


def _means(df: DataFrame, columns: Sequence[str], decimals: int | None) -> Column:
    """All means in one aggregate, as a scalar subquery with one field per column."""
    fields = []
    for column in columns:
        value = F.col(column).cast("double")
        mean = F.avg(F.when(~F.isnan(value), value))
        if decimals is not None:
            mean = F.floor(mean * 10**decimals) / 10**decimals
        fields.append(mean.alias(column))
    return df.agg(F.struct(*fields).alias("means")).scalar()


def members(df: DataFrame, key: str, class_column: str, wanted: str) -> DataFrame:
    """Keys of one class."""
    return df.where(F.col(class_column) == wanted).select(key)


def first_members(df: DataFrame, key: str, class_column: str, wanted: str, n: int) -> DataFrame:
    """First ``n`` keys of one class in key order."""
    return top_rows(members(df, key, class_column, wanted), [F.col(key)], n)


def in_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows that occur in every frame."""
    return reduce(lambda left, right: left.intersect(right), frames)


def always(df: DataFrame, key: str, class_columns: Sequence[str], wanted: str) -> DataFrame:
    """Keys that are in the class in every column: one scan in place of a chain of joins."""
    test = reduce(lambda a, b: a & b, [F.col(c) == wanted for c in class_columns])
    return df.where(test).select(key).distinct()


def keep_common(frames: Mapping[str, DataFrame], key: str, name: str = "source") -> DataFrame:
    """Rows of each frame whose key occurs in all of them, put together and sorted."""
    common = in_all([frame.select(key) for frame in frames.values()])
    kept = [
        frame.join(common, key, "left_semi").withColumn(name, F.lit(label))
        for label, frame in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), kept).orderBy(key, name)
