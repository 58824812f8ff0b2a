"""The report over a click log: every chart's table from as few scans as possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.rates import rate_summary
from tallyloom.sources.files import read_click_log, write_table

# The report's charts and the columns they are drawn over.
CHARTS = {
    "hours": "hour_in_day",
    "week_days": "day_name",
    "banner": "banner_pos",
    "device": "device_type",
}
TOTAL = "clicks"


def report(df: DataFrame) -> DataFrame:
    """All chart tables in long form: chart, key, clicks, impressions, rate."""
    return rate_summary(df, CHARTS, total=TOTAL)


def write_report(df: DataFrame, folder: str) -> None:
    """Write the report, one folder per chart."""
    write_table(report(df), folder, "chart")


def report_on_file(spark: SparkSession, path: str, folder: str) -> None:
    """The whole report from one click log in CSV."""
    write_report(read_click_log(spark, path), folder)
