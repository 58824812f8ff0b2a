"""Folders to which batches are added one after the other, each visible as a whole or not at all.

A batch writes its data under a name of its own and then adds one row-group file to the log of
the folder. What the log does not name does not exist: a batch that failed half-way is never
read. Readers see the log as it was when they began.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "log"


def new_batch() -> str:
    """A name that no other batch has."""
    return f"b{uuid.uuid4().hex}"


def add_to_log(rows: DataFrame, folder: str) -> None:
    """Make a batch visible: its rows of the log, as one file that appears at once."""
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/{LOG}")


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The log of a folder; no rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{LOG}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def next_number(log: DataFrame) -> int:
    """One more than the greatest ``number`` in the log."""
    return (log.agg(F.max("number")).first()[0] or 0) + 1


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
