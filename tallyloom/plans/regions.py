"""The regional job: classes per year, their sizes, and the regions always in one class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.classes import MEAN, always, classify
from tallyloom.operators.rates import frequencies_of
from tallyloom.operators.reshape import series
from tallyloom.operators.small import pin
from tallyloom.sources.files import read_csv, write_table

# Class names of the two regional tables; means are cut to four decimals.
RAINFALL = ("Low Rainfall Region", "High Rainfall Region")
INCOME = ("Low Per Capita Income", "High Per Capita Income")
DECIMALS = 4


def classes(
    df: DataFrame,
    columns: Sequence[str],
    names: tuple[str, str],
    thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """Class every column by its given threshold, or by its mean."""
    limits = {c: (thresholds or {}).get(c, MEAN) for c in columns}
    return classify(df, limits, *names, decimals=DECIMALS)


def regional_report(
    spark: SparkSession,
    path: str,
    folder: str,
    columns: Sequence[str],
    names: tuple[str, str],
    key: str = "district",
) -> None:
    """Classes, class sizes, always-high regions and line-chart data of one CSV.

    The file is read twice, for its types and for its rows; all tables come from what was read.
    """
    table = pin(read_csv(spark, path))
    classed = pin(classes(table, columns, names))
    class_columns = [f"class_{c}" for c in columns]
    write_table(classed, f"{folder}/classes")
    write_table(frequencies_of(classed, class_columns), f"{folder}/class_sizes")
    write_table(always(classed, key, class_columns, names[1]), f"{folder}/always_high")
    write_table(series(table, key, columns), f"{folder}/series")
