"""Several tables published as one: readers see all of a set or all of the set before."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.commits import add_to_log, new_batch, next_number, read_log, remove

SETS = "sets"
LOG_FIELDS = "number bigint, batch string, tables array<string>"


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> int:
    """Write the tables as the next set of ``folder`` and make it the current one.

    All tables are written to a place of their own first; the set counts from the moment its
    line is in the log, which is written last. If any table fails the set before stays current.
    Returns the number of the set.
    """
    if not tables:
        raise ValueError("a set has at least one table")
    batch = new_batch()
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{SETS}/{batch}/{name}")
    number = next_number(published_sets(spark, folder))
    add_to_log(spark.createDataFrame([(number, batch, sorted(tables))], LOG_FIELDS), folder)
    return number


def published_sets(spark: SparkSession, folder: str) -> DataFrame:
    """``number``, ``batch`` and ``tables`` of every set."""
    return read_log(spark, folder, LOG_FIELDS)


def _set(spark: SparkSession, folder: str, number: int | None):
    sets = published_sets(spark, folder)
    if number is not None:
        sets = sets.where(F.col("number") == number)
    # Of two that were published at the same time one is the later, the same for all readers.
    found = sets.orderBy(F.desc("number"), F.desc("batch")).first()
    if found is None:
        raise LookupError(f"{folder}: no set published" if number is None else f"{folder}: no set {number}")
    return found


def published(
    spark: SparkSession, folder: str, *names: str, number: int | None = None
) -> dict[str, DataFrame]:
    """Tables of the current set (or of the set of that number), by name; all if none is named.

    The set is chosen once for all of them, so they belong together whatever is published
    meanwhile.
    """
    found = _set(spark, folder, number)
    missing = set(names) - set(found.tables)
    if missing:
        raise LookupError(f"{folder}: no table {', '.join(sorted(missing))}")
    at = f"{folder}/{SETS}/{found.batch}"
    return {name: spark.read.parquet(f"{at}/{name}") for name in names or found.tables}


def forget_old_sets(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete the tables of all but the ``keep`` last sets; their lines in the log stay. Readers of
    a set that goes fail, so keep as many as are published while a reader may be at work."""
    if keep < 1:
        raise ValueError("the current set must stay")
    sets = published_sets(spark, folder).orderBy(F.desc("number"), F.desc("batch")).collect()
    for old in sets[keep:]:
        remove(spark, f"{folder}/{SETS}/{old.batch}")
