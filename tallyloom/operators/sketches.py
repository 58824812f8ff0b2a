"""Mergeable summaries of wide columns: distinct counts, quantiles, most frequent values.

A sketch has a bounded size whatever the column holds. Sketches of parts (days, files) are
stored as columns of a table and merged later; nothing is read again for a longer period. The
input is scanned once, and a task sends one sketch per column and part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.profile import every_column
from tallyloom.operators.rates import frequencies_of
from tallyloom.operators.reshape import to_long
from tallyloom.operators.small import pin

#: Two to this power registers of a distinct sketch: a byte each.
REGISTERS_LOG = 12
#: Size of a quantile sketch; it holds a few hundred values more than this.
QUANTILE_SIZE = 400
#: Values that a sketch of frequent values holds.
TRACKED = 4096

DISTINCT, QUANTILE = "distinct_sketch", "quantile_sketch"


def distinct_error(registers_log: int = REGISTERS_LOG) -> float:
    """Standard error of a merged estimate, as a share of the true count."""
    return 1.04 / 2 ** (registers_log / 2)


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """Share of all rows by which the rank of a value may be off, with 99 % confidence."""
    return 2.296 / size**0.9723


def frequency_error(tracked: int = TRACKED) -> float:
    """A value with more than this share of all rows is among those tracked."""
    return 3.5 * 0.75 / tracked


# --- distinct values -------------------------------------------------------------------


def distinct_sketches(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), registers_log: int = REGISTERS_LOG
) -> DataFrame:
    """A sketch of the different non-null values of each column, per value of ``by``.

    Columns: ``by``, ``column``, ``distinct_sketch``. A column without a value has no row.
    """
    long = to_long(df, list(by), columns, variable="column", as_type="string")
    sketch = F.hll_sketch_agg("value", registers_log).alias(DISTINCT)
    return long.where("value IS NOT NULL").groupBy(*by, "column").agg(sketch)


def merged_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of all parts put together, per value of ``by``. They hold what one sketch of all rows
    would; the estimate may differ within its error, as it is read off in another way."""
    return sketches.groupBy(*by, "column").agg(F.hll_union_agg(DISTINCT).alias(DISTINCT))


def distinct_estimates(
    sketches: DataFrame, columns: Sequence[str] = (), registers_log: int = REGISTERS_LOG, errors: float = 3.0
) -> DataFrame:
    """``n_distinct`` with ``low`` and ``high``, so many standard errors away, in place of the
    sketch. Of ``columns`` those without a sketch are added with 0."""
    estimate = F.hll_sketch_estimate(DISTINCT)
    margin = errors * distinct_error(registers_log)
    found = sketches.withColumn("n_distinct", estimate).withColumns(
        {"low": F.floor(F.col("n_distinct") * (1 - margin)), "high": F.ceil(F.col("n_distinct") * (1 + margin))}
    )
    found = found.drop(DISTINCT)
    return every_column(found, columns, "n_distinct", "low", "high") if columns else found


# --- quantiles -------------------------------------------------------------------------


def quantile_sketches(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = QUANTILE_SIZE
) -> DataFrame:
    """A sketch of the distribution of each numeric column, per value of ``by``; null and NaN do
    not count.

    Columns: ``by``, ``column``, ``quantile_sketch``. Sketches are drawn at random: two runs may
    differ within the error of :func:`rank_error`, which holds for merged ones as well.
    """
    long = to_long(df, list(by), columns, variable="column", as_type="double")
    sketch = F.kll_sketch_agg_double("value", size).alias(QUANTILE)
    return long.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*by, "column").agg(sketch)


def merged_quantiles(sketches: DataFrame, by: Sequence[str] = (), size: int = QUANTILE_SIZE) -> DataFrame:
    """Sketches of all parts put together, per value of ``by``."""
    return sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double(QUANTILE, size).alias(QUANTILE))


def quantile_estimates(sketches: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """A row per sketch and probability, with the ``value`` at that share of the rows and the
    ``count`` of all, in place of the sketch."""
    entries = [
        F.struct(
            F.lit(float(p)).alias("probability"),
            F.kll_sketch_get_quantile_double(QUANTILE, F.lit(float(p))).alias("value"),
        )
        for p in probabilities
    ]
    others = [c for c in sketches.columns if c != QUANTILE]
    count = F.kll_sketch_get_n_double(QUANTILE).alias("count")
    return sketches.select(*others, count, F.inline(F.array(*entries)))


def ranks_of(df: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` (``column``, ``value``, one row per estimate) with the exact share of the rows
    of ``df`` ``below`` each value, and ``upto`` it: one scan, as a check of a sketch."""
    columns = [r[0] for r in values.select("column").distinct().collect()]
    long = to_long(df, [], columns, variable="column", as_type="double").where("value IS NOT NULL AND NOT isnan(value)")
    # A few rows per column, whatever the table holds.
    asked = F.broadcast(values.withColumnRenamed("value", "at"))
    ranks = long.join(asked, "column").groupBy(*asked.columns).agg(
        F.avg((F.col("value") < F.col("at")).cast("int")).alias("below"),
        F.avg((F.col("value") <= F.col("at")).cast("int")).alias("upto"),
    )
    return ranks.withColumnRenamed("at", "value")


# --- most frequent values --------------------------------------------------------------


def _tracked(long: DataFrame, tracked: int) -> DataFrame:
    """``column`` and ``value`` of the values that the sketches hold (null if one holds none, as no
    value is frequent), and the column's ``rows``."""
    sketch = F.call_function("approx_top_k", F.col("value"), F.lit(tracked), F.lit(tracked))
    found = long.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), sketch.alias("items"))
    return found.select("column", "rows", F.explode_outer("items.item").alias("value"))


def _first(counted: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def top_values(df: DataFrame, columns: Sequence[str], k: int, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values of each column with their exact counts, and their
    ``place``; of equally frequent ones the smallest (as text) come first.

    One scan makes a sketch per column, which holds every value with more than
    :func:`frequency_error` of the rows, and a second one counts the values it holds: no task
    sends more than ``tracked`` values of a column. The result is exact where the last of the
    ``k`` has more rows than any value left out can have, or nothing was left out. A column of
    which neither is true, as it has no frequent values, is counted in full instead.
    """
    if not 0 < k <= tracked:
        raise ValueError("k must lie between 1 and the number of values tracked")
    names = list(columns)

    def long(of: Sequence[str]) -> DataFrame:
        rows = to_long(df, [], of, variable="column", as_type="string")
        return rows.where("value IS NOT NULL")

    candidates = pin(_tracked(long(names), tracked))
    # At most ``tracked`` values for each of the columns.
    exact = long(names).join(F.broadcast(candidates.select("column", "value")), ["column", "value"])
    exact = pin(exact.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    first = pin(_first(exact, k))
    rows = candidates.groupBy("column").agg(F.first("rows").alias("rows"))
    held = exact.groupBy("column").agg(F.sum("n").alias("held"))
    last = first.groupBy("column").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("found"))
    clear: Column = (F.col("found") == k) & (F.col("least") > F.lit(frequency_error(tracked)) * F.col("rows"))
    proven = rows.join(held, "column").join(last, "column").where(clear | (F.col("held") == F.col("rows")))
    known = {r["column"] for r in proven.select("column").collect()}
    kept = first.where(F.col("column").isin(sorted(known)))
    found = {r["column"] for r in rows.select("column").collect()}
    open_ = [c for c in names if c in found - known]
    if not open_:
        return kept
    return kept.unionByName(_first(pin(frequencies_of(df, open_)), k))


# --- stored by part --------------------------------------------------------------------


def store_by_part(sketches: DataFrame, part: str, path: str) -> None:
    """Keep sketches in a table with a folder per value of ``part``. Parts that are there are
    replaced, others stay."""
    writer = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(part).parquet(path)


def stored_parts(spark: SparkSession, path: str, part: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored sketches from part ``first`` to part ``last``; other folders are not read."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col(part) >= first)
    if last is not None:
        rows = rows.where(F.col(part) <= last)
    return rows
