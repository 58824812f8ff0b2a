"""Wide to long, long to wide, and transposing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.small import levels

NULL_KEY = "null"


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    variable: str = "variable",
    value: str = "value",
    as_type: str | None = None,
) -> DataFrame:
    """One row per input row and value column. ``as_type`` casts values of mixed types."""
    if as_type:
        df = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in values])
    return df.unpivot(list(ids), list(values), variable, value)


def series(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Line-chart data: one point per key and column, in key order."""
    return to_long(df, [key], values).orderBy(key, "variable")


def transpose(
    df: DataFrame, key: str, values: Sequence[str], names: Sequence | None = None
) -> DataFrame:
    """Columns become rows and rows become columns, named by ``key``.

    A null key becomes the column ``null``. A repeated key raises an error when the result is
    computed, as one column cannot hold two rows. ``names`` gives the keys that become
    columns, if not all are wanted.
    """
    if names is None:
        names = levels(df, [key])[key]
        if df.where(F.col(key).isNull()).limit(1).count():
            names = [*names, NULL_KEY]
    text = F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY))
    long = to_long(df.withColumn(key, text), [key], values)
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"{key}: a value is repeated")))
    single = long.groupBy("variable", key).agg(F.coalesce(one, F.max("value")).alias("value"))
    cells = [F.max(F.when(F.col(key) == F.lit(str(n)), F.col("value"))).alias(str(n)) for n in names]
    return single.groupBy("variable").agg(*cells)
