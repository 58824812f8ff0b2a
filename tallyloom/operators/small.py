"""Results that are used several times, and values that become columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import scratch_folder


def pin(df: DataFrame) -> DataFrame:
    """Compute a result once and hold it in the shared folder, whatever its size.

    It comes back as a scan of what was written, so Spark knows its size and chooses joins by
    it.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are worth a task in a job that is run hundreds of times, and rows of a task at most.
TASK_ROWS, MOST_ROWS = 10_000, 200_000


def spread(df: DataFrame) -> DataFrame:
    """The rows in even parts, for iterative fits, which run a task per part in every iteration.

    A held result keeps the session's number of shuffle partitions, however few rows it has, and
    starting the tasks then takes longer than their work. Here a part has at least ``TASK_ROWS``
    rows while there are no more parts than cores, and at most about ``MOST_ROWS`` beyond that.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(math.ceil(rows / TASK_ROWS), cores), math.ceil(rows / MOST_ROWS), 1)
    return df.repartition(parts)


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct non-null values, as text, of columns whose values become columns.

    One scan for all columns. Numbers come in numeric order. The values go through the
    driver, as the columns of any plan do: callers whose columns have very many values pass the
    wanted ones, or stay in the long form.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    pairs = texts.unpivot([], list(columns), "column", "value").where("value IS NOT NULL").distinct()
    found = pairs.collect()
    kinds = dict(df.dtypes)
    order = {c: str if kinds[c] in ("string", "boolean") else float for c in columns}
    return {c: sorted((r[1] for r in found if r[0] == c), key=order[c]) for c in columns}
