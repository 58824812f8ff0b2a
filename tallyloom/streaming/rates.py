"""Rates over a growing folder of click logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.calendar import with_calendar
from tallyloom.operators.rates import click_rates
from tallyloom.sources.files import write_table


def log_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet log files as they arrive, with calendar columns."""
    files = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return with_calendar(files)


def keep_rates(log: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Bring the rate table at ``out`` up to date with all files there are, then stop.

    State is one pair of counts per key, so it does not grow with the log. Each batch
    replaces the whole small table; running it again after a failure gives the same table.
    """
    return (
        click_rates(log, key)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda table, _: write_table(table, out))
        .start()
    )
