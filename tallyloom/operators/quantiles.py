"""Exact quantiles of whole columns, without one task holding a column.

An exact quantile needs the values at one or two ranks. The first scan finds, beside the moments,
an approximate percentile just below and just above each wanted rank. The second scan counts
the rows under each such span, and how often each value inside it occurs: about one value in
a thousand, however the values are spread. What is left is folded and stored, and its running
counts, range by range, give the values at the ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyloom.operators.reshape import to_long
from tallyloom.operators.small import pin

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 10_000
MARGIN = 2 / ACCURACY


@dataclass(frozen=True)
class Span:
    """Values ``low..high`` of a column, which should hold those at ``ranks``."""

    column: str
    ranks: tuple[int, ...]
    low: float
    high: float


def number(column: str) -> Column:
    """The column as double with NaN as null."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def moments(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUARTILES
) -> dict[str, Row]:
    """Count, mean, deviation, range and the edges around each quantile, one pass for all.

    The columns are aggregated in long form: six functions for all of them make code the JVM
    compiles, six for each would not.
    """
    around = [e for p in probabilities for e in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    summary = {
        "count": F.count("value"),
        "mean": F.avg("value"),
        "std": F.stddev_samp("value"),
        "min": F.min("value"),
        "max": F.max("value"),
        "edges": F.percentile_approx("value", F.array(*map(F.lit, around)), ACCURACY),
    }
    long = to_long(df, [], columns, variable="column", as_type="double")
    table = (
        long.where("value IS NOT NULL AND NOT isnan(value)")
        .groupBy("column")
        .agg(*[f.alias(name) for name, f in summary.items()])
    )
    found = {row["column"]: row for row in table.collect()}
    nothing = Row("column", *summary)
    return {c: found.get(c, nothing(c, 0, *[None] * 5)) for c in columns}


def quantiles(
    df: DataFrame, found: Mapping[str, Row], probabilities: Sequence[float] = QUARTILES
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column whose moments are given."""
    spans = [
        Span(column, _ranks(p, m["count"]), m["edges"][2 * i], m["edges"][2 * i + 1])
        for column, m in found.items()
        if m["count"]
        for i, p in enumerate(probabilities)
    ]
    values = _values_at(df, spans, found)
    result: dict[str, list[float | None]] = {}
    for column, m in found.items():
        if not m["count"]:
            result[column] = [None] * len(probabilities)
            continue
        result[column] = []
        for p in probabilities:
            low, high = _ranks(p, m["count"])
            a, b = values[column, low], values[column, high]
            result[column].append(a + (p * (m["count"] - 1) - low) * (b - a))
    return result


def _ranks(p: float, n: int) -> tuple[int, int]:
    """The 0-based ranks a quantile lies between."""
    low = floor(p * (n - 1))
    return low, min(low + 1, n - 1)


def _folded(df: DataFrame, spans: Sequence[Span]) -> DataFrame:
    """(span, value, n): how often each value of a span occurs; null stands for all below it."""
    entries = [
        F.when(
            number(s.column) <= s.high,
            F.struct(
                F.lit(i).alias("span"),
                F.when(number(s.column) >= s.low, number(s.column)).alias("value"),
            ),
        )
        for i, s in enumerate(spans)
    ]
    rows = df.select(F.inline(F.array(*entries))).where("span IS NOT NULL")
    return pin(rows.groupBy("span", "value").agg(F.count(F.lit(1)).alias("n")))


def _values_at(
    df: DataFrame, spans: Sequence[Span], found: Mapping[str, Row]
) -> dict[tuple[str, int], float]:
    """The values at the ranks of all spans."""
    if not spans:
        return {}
    folded = _folded(df, spans)
    counts = {
        r["span"]: r
        for r in folded.groupBy("span").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("below"),
            F.sum("n").alias("upto"),
        ).collect()
    }
    held = {
        i: c["below"]
        for i, c in counts.items()
        if c["below"] <= spans[i].ranks[0] and spans[i].ranks[-1] < c["upto"]
    }
    values = _read_off(folded, {i: s for i, s in enumerate(spans) if i in held}, held)
    # Few rows can have ranks that the percentiles' margin does not span: whole columns then.
    missed = [s for i, s in enumerate(spans) if i not in held]
    if missed:
        whole = [replace(s, low=found[s.column]["min"], high=found[s.column]["max"]) for s in missed]
        everything = dict.fromkeys(range(len(whole)), 0)
        values |= _read_off(_folded(df, whole), dict(enumerate(whole)), everything)
    return values


def _read_off(
    folded: DataFrame, spans: Mapping[int, Span], below: Mapping[int, int]
) -> dict[tuple[str, int], float]:
    """Values at the ranks, by running counts inside ranges of values and over the ranges."""
    if not spans:
        return {}
    inside = folded.where("value IS NOT NULL").repartitionByRange("span", "value")
    ranges = pin(inside.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("span").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("span", "_range").agg(F.sum("n").alias("_n")).select(
        "span", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    upto = Window.partitionBy("span", "_range").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = ranges.withColumn("_upto", F.sum("n").over(upto)).join(offsets, ["span", "_range"])
    wanted = pa.table(
        {
            "span": pa.array([i for i, s in spans.items() for _ in s.ranks], pa.int32()),
            "rank": pa.array([r for s in spans.values() for r in s.ranks], pa.int64()),
            "at": pa.array([r - below[i] for i, s in spans.items() for r in s.ranks], pa.int64()),
        }
    )
    last = F.col("_before") + F.col("_upto")
    hits = (
        running.join(folded.sparkSession.createDataFrame(wanted), "span")
        .where((last - F.col("n") <= F.col("at")) & (F.col("at") < last))
        .select("span", "rank", "value")
    )
    return {(spans[r["span"]].column, r["rank"]): r["value"] for r in hits.collect()}
