"""Counts, crosstabs and click-through rates by key.

Null keys belong to no group and are dropped. Every aggregate combines inside the map
tasks first, so a key that holds a third of all rows sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.rates import clicks, impressions, is_click, percent
from tallyloom.operators.ordering import ranked
from tallyloom.operators.reshape import to_long
from tallyloom.operators.small import levels


def with_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are neither null nor NaN."""
    kinds = dict(df.dtypes)
    for key in keys:
        df = df.where(F.col(key).isNotNull())
        if kinds[key] in ("double", "float"):
            df = df.where(~F.isnan(key))
    return df


def count_rows(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key."""
    return with_key(df, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_values(df: DataFrame, key: str, column: str, name: str = "n") -> DataFrame:
    """Non-null values of ``column`` per key, most first."""
    counted = with_key(df, key).groupBy(key).agg(F.count(column).alias(name))
    return counted.orderBy(F.desc(name), key)


def sum_clicks(df: DataFrame, key: str, click: str = "click", name: str = "clicks") -> DataFrame:
    """Clicks per key, keys without any included."""
    return with_key(df, key).groupBy(key).agg(clicks(click).alias(name))


def ranked_clicks(df: DataFrame, key: str, click: str = "click", name: str = "clicks") -> DataFrame:
    """Clicks per key, most first."""
    return sum_clicks(df, key, click, name).orderBy(F.desc(name), key)


def frequencies(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, most first."""
    return count_rows(df, column, name=name).orderBy(F.desc(name), column)


def frequencies_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency tables of several columns from one scan, in long form."""
    long = to_long(df.select(*columns), [], columns, variable="column", value="value", as_type="string")
    counted = count_rows(long, "column", "value")
    return counted.orderBy("column", F.desc("n"), "value")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among all rows; rows with a null count in the whole only.

    Nulls are left out by their share, not by the column: a filter on the column would move
    into the scan, and the whole, which needs the null rows, would then be a second scan.
    """
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n")).scalar()
    share = F.when(F.col(column).isNotNull(), F.col("n") / whole)
    return counted.withColumn("share", share).where("share IS NOT NULL")


def crosstab(
    df: DataFrame,
    key: str,
    target: str = "click",
    values: Mapping[str, object] | None = None,
) -> DataFrame:
    """Rows per key and target value, one column per value; an empty cell is null.

    ``values`` names the cells, e.g. ``{"no_click": False, "click": True}``; without it the
    values found in the data become the columns. One aggregate of conditional counts, where
    a pivot would aggregate and shuffle twice.
    """
    if values is None:
        values = {text: text for text in levels(df, [target])[target]}
    kind = dict(df.dtypes)[target]
    cells = [
        F.nullif(F.count_if(F.col(target) == F.lit(v).cast(kind)), F.lit(0)).alias(name)
        for name, v in values.items()
    ]
    return with_key(df, key, target).groupBy(key).agg(*cells)


def crosstabs_of(
    df: DataFrame, keys: Sequence[str], target: str, values: Mapping[str, object]
) -> DataFrame:
    """Crosstabs of several keys with one target from one scan, in long form."""
    long = to_long(df, [target], keys, variable="column", value="value", as_type="string")
    cells = [
        F.nullif(F.count_if(F.col(target) == F.lit(v)), F.lit(0)).alias(name)
        for name, v in values.items()
    ]
    return with_key(long, "value", target).groupBy("column", "value").agg(*cells)


# Names of the two cells of a crosstab by click.
BY_CLICK = {"no_click": False, "click": True}
ONLY_CLICK = {"click": True}


def crosstab_shares(
    df: DataFrame, key: str, target: str = "click", values: Mapping[str, object] = BY_CLICK
) -> DataFrame:
    """Crosstab with every row divided by its sum; an empty cell stays null."""
    table = crosstab(df, key, target, values)
    whole = sum((F.coalesce(F.col(c), F.lit(0)) for c in values), F.lit(0))
    return table.select(key, *[F.try_divide(F.col(c), whole).alias(c) for c in values])


def click_rates(df: DataFrame, key: str, click: str = "click") -> DataFrame:
    """Clicks, impressions and click-through rate per key, best rate first.

    Keys without a click are left out. Clicks and impressions come from the same row of the
    same aggregate, so they cannot slip against each other.
    """
    table = with_key(df, key).groupBy(key).agg(
        clicks(click).alias("clicks"), impressions(click).alias("impressions")
    )
    return rate_table(table, key)


def rate_table(table: DataFrame, key: str) -> DataFrame:
    """Finish a table of clicks and impressions per key into rates, best first."""
    return (
        table.where(F.col("clicks") > 0)
        .withColumn("rate", percent(F.col("clicks"), F.col("impressions")))
        .orderBy(F.desc("rate"), key)
    )


def click_rates_joined(df: DataFrame, key: str, click: str = "click") -> DataFrame:
    """The same table as :func:`click_rates` by way of two aggregates joined on the key."""
    clicked = sum_clicks(df.where(is_click(click)), key, click)
    shown = with_key(df, key).groupBy(key).agg(impressions(click).alias("impressions"))
    joined = clicked.join(shown, key, "inner")
    return rate_table(joined.select(key, "clicks", "impressions"), key)


def click_rates_through(
    facts: DataFrame,
    facts_key: str,
    lookup: DataFrame,
    lookup_key: str,
    key: str,
    click: str = "click",
) -> DataFrame:
    """Rates by a column that sits in a lookup table.

    The facts are aggregated by their foreign key before the join. What meets the lookup
    table is one row per foreign key, however often a hot one occurs.
    """
    folded = (
        with_key(facts, facts_key)
        .groupBy(facts_key)
        .agg(clicks(click).alias("clicks"), impressions(click).alias("impressions"))
    )
    named = lookup.select(F.col(lookup_key).alias(facts_key), key)
    table = (
        with_key(folded.join(named, facts_key, "inner"), key)
        .groupBy(key)
        .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    )
    return rate_table(table, key)


def keys_by_rate(df: DataFrame, key: str, click: str = "click") -> DataFrame:
    """Keys in order of their rate, with the place of each."""
    table = click_rates(df, key, click)
    return ranked(table, [F.desc("rate"), F.col(key)], name="place").select("place", key, "rate").orderBy("place")


def rate_summary(
    df: DataFrame, charts: Mapping[str, str], click: str = "click", total: str | None = None
) -> DataFrame:
    """Rate tables of several keys from one scan, in long form.

    ``charts`` maps the name of each table to its key column. The rows are folded by all
    keys together before the grouping sets multiply them, which keeps the multiplied input
    as small as the product of the keys' value counts (these are report dimensions: hours,
    days, positions). ``total`` names an extra table of a single row over everything.
    """
    folded = fold_counts(df, list(charts.values()), click)
    return summary_of_counts(folded, charts, total)


def fold_counts(df: DataFrame, keys: Sequence[str], click: str = "click") -> DataFrame:
    """Clicks and impressions for each combination of the keys."""
    return df.groupBy(*keys).agg(clicks(click).alias("clicks"), impressions(click).alias("impressions"))


def summary_of_counts(folded: DataFrame, charts: Mapping[str, str], total: str | None = None) -> DataFrame:
    """The same table from counts by the keys of all charts; counts of equal keys add up."""
    keys = list(charts.values())
    sets: list[list[Column]] = [[F.col(k)] for k in keys]
    if total:
        sets.append([])
    # grouping_id has one bit per key, the first key highest; a bit is 0 for the key in use.
    whole = 2 ** len(keys) - 1
    code = {name: whole - 2 ** (len(keys) - 1 - i) for i, name in enumerate(charts)}
    chart = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for name, key in charts.items():
        chart = F.when(F.col("_set") == code[name], name).otherwise(chart)
        value = F.when(F.col("_set") == code[name], F.col(key).cast("string")).otherwise(value)
    if total:
        chart = F.when(F.col("_set") == whole, total).otherwise(chart)
        value = F.when(F.col("_set") == whole, "all").otherwise(value)
    table = (
        folded.groupingSets(sets, *[F.col(k) for k in keys])
        .agg(
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            F.grouping_id().alias("_set"),
        )
        .select(chart.alias("chart"), value.alias("key"), "clicks", "impressions")
        .where("key IS NOT NULL AND clicks > 0")
    )
    return table.withColumn("rate", percent(F.col("clicks"), F.col("impressions")))
