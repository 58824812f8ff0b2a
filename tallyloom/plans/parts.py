"""The report kept up to date by parts: counts per input file, merged on demand.

Every input file is counted once, by the keys of all charts together. The counts are stored
with a log of the files they came from. A report adds up the stored counts, so a new day costs
reading that day.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.rates import fold_counts, summary_of_counts
from tallyloom.operators.small import pin
from tallyloom.plans.report import CHARTS, TOTAL
from tallyloom.sources.commits import add_to_log, new_batch, next_number, read_log
from tallyloom.sources.files import read_click_log
from tallyloom.sources.publish import publish

COUNTS = "counts"
LOG_FIELDS = "file string, bytes bigint, modified timestamp, number bigint, batch string"
SAME = ["file", "bytes", "modified"]
Reader = Callable[[SparkSession, Sequence[str]], DataFrame]


def input_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``bytes``, ``modified`` and ``path`` of every file under a path, without reading
    one. ``file`` names it as :func:`file_of_row` does."""
    found = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return found.select(
        _one_form(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
        "path",
    )


def _one_form(name: Column) -> Column:
    """A file's name with one stroke after the scheme, of which Spark writes one or three."""
    return F.regexp_replace(name, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def file_of_row() -> Column:
    """The file that a row was read from."""
    return _one_form(F.input_file_name())


def counted_files(spark: SparkSession, store: str) -> DataFrame:
    """The files a store has counts of, each as it was when last counted, with its batch."""
    log = read_log(spark, store, LOG_FIELDS)
    last = Window.partitionBy("file").orderBy(F.desc("number"), F.desc("batch"))
    return log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def count_new_files(
    spark: SparkSession,
    path: str | Sequence[str],
    store: str,
    keys: Sequence[str] = tuple(CHARTS.values()),
    read: Reader = read_click_log,
) -> int:
    """Count the files under ``path`` that the store does not have, and add them to it.

    Files are the same if name, size and time of change are; one that changed is counted again
    and replaces what it was. Files that are gone keep their counts. Two runs at a time may
    count a file twice, but only one of its counts is ever used. A run that fails leaves the
    store as it was. ``read`` gives the rows of files by their names. Returns the number of files
    counted; their names (not more) go through the driver, as those of any scan do.
    """
    known = counted_files(spark, store).select(*SAME)
    new = pin(input_files(spark, path).join(known, SAME, "left_anti"))
    names = [_literal(r.path) for r in new.select("path").collect()]
    if not names:
        return 0
    batch = new_batch()
    rows = read(spark, names).withColumn("file", file_of_row())
    fold_counts(rows, ["file", *keys]).write.parquet(f"{store}/{COUNTS}/batch={batch}")
    number = next_number(read_log(spark, store, LOG_FIELDS))
    add_to_log(new.select(*SAME, F.lit(number).cast("bigint").alias("number"), F.lit(batch).alias("batch")), store)
    return len(names)


def _literal(path: str) -> str:
    """A path whose special characters do not stand for others."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """The counts of all files, each counted once: ``file``, the keys, ``clicks``, ``impressions``."""
    counts = spark.read.parquet(f"{store}/{COUNTS}")
    return counts.join(counted_files(spark, store).select("file", "batch"), ["file", "batch"]).drop("batch")


def stored_report(
    spark: SparkSession, store: str, charts: Mapping[str, str] = CHARTS, total: str | None = TOTAL
) -> DataFrame:
    """The report over all files counted so far, from the stored counts alone."""
    keys = list(charts.values())
    folded = stored_counts(spark, store).groupBy(*keys).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")
    )
    return summary_of_counts(folded, charts, total)


def bring_up_to_date(spark: SparkSession, path: str, store: str, folder: str) -> int:
    """Count what is new under ``path`` and publish the report as a set of one table per chart.
    Without a new file nothing is published. Returns the number of files counted."""
    counted = count_new_files(spark, path, store)
    if counted:
        report = pin(stored_report(spark, store))
        charts = {name: report.where(F.col("chart") == name).drop("chart") for name in (*CHARTS, TOTAL)}
        publish(spark, charts, folder)
    return counted
