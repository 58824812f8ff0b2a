import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import sketches
from tallyloom.operators.profile import count_distinct, describe_numeric
from tallyloom.operators.rates import frequencies_of

WIDE_ROWS = 60_000


@pytest.fixture(scope="module")
def wide(spark):
    """A column of many values, one of few, one with a hot value, one without any."""
    i = F.col("id")
    return spark.range(WIDE_ROWS).select(
        (i % 7).cast("string").alias("day"),
        F.concat(F.lit("v"), (F.xxhash64(i) % 40_000).cast("string")).alias("many"),
        (i % 5).alias("few"),
        F.when(i % 3 == 0, -1).otherwise(i).alias("hot"),
        F.lit(None).cast("string").alias("none"),
    ).repartition(9)


COLUMNS = ["many", "few", "hot", "none"]


def estimates(df):
    return {r["column"]: (r["n_distinct"], r["low"], r["high"]) for r in df.collect()}


def test_merged_sketches_of_days_give_what_one_sketch_gives(spark, wide, tmp_path):
    path = str(tmp_path / "sketches")
    by_day = sketches.distinct_sketches(wide, COLUMNS, ["day"])
    sketches.store_by_part(by_day, "day", path)
    merged = sketches.merged_distinct(sketches.stored_parts(spark, path, "day"))
    got = estimates(sketches.distinct_estimates(merged, COLUMNS))
    direct = sketches.merged_distinct(sketches.distinct_sketches(wide, COLUMNS))
    assert got == estimates(sketches.distinct_estimates(direct, COLUMNS))
    exact = {r["column"]: r["n_distinct"] for r in count_distinct(wide, COLUMNS).collect()}
    assert exact["many"] > 25_000 and exact["none"] == 0
    for column, n in exact.items():
        estimate, low, high = got[column]
        assert abs(estimate - n) <= 3 * sketches.distinct_error() * n and low <= estimate <= high
    # A sketch that is too small is off by more.
    small = sketches.distinct_sketches(wide, ["many"], registers_log=4)
    rough = estimates(sketches.distinct_estimates(sketches.merged_distinct(small)))["many"][0]
    assert abs(rough - exact["many"]) > sketches.distinct_error() * exact["many"]


def test_a_day_is_replaced_and_only_asked_days_are_read(spark, wide, tmp_path):
    path = str(tmp_path / "days")
    few = wide.where("few < 2")
    sketches.store_by_part(sketches.distinct_sketches(few, ["few"], ["day"]), "day", path)
    sketches.store_by_part(sketches.distinct_sketches(wide.where("day = '3'"), ["few"], ["day"]), "day", path)
    of = lambda first, last: sketches.distinct_estimates(
        sketches.merged_distinct(sketches.stored_parts(spark, path, "day", first, last))
    ).first()["n_distinct"]
    assert of(None, None) == of("3", "3") == 5
    assert of("4", "6") == 2
    plan = sketches.stored_parts(spark, path, "day", "3", "4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: []" in plan


def test_quantiles_of_merged_sketches(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.exp(rng.normal(0, 5, 30_000)), np.full(15_000, 3.25)])
    rows = [(int(i % 11), float(v), float("nan") if i % 10 == 0 else float(i)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "part int, x double, y double").repartition(6)
    by_part = sketches.quantile_sketches(df, ["x", "y"], ["part"])
    assert by_part.count() == 22
    asked = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = sketches.quantile_estimates(sketches.merged_quantiles(by_part), asked)
    assert {r["count"] for r in found.where("column = 'x'").collect()} == {45_000}
    ranks = sketches.ranks_of(df, found.select("column", "probability", "value"))
    margin = 2 * sketches.rank_error()
    got = ranks.collect()
    assert len(got) == 12
    for r in got:
        assert r.below - margin <= r.probability <= r.upto + margin
    exact = {r["column"]: r for r in describe_numeric(df, ["x", "y"]).collect()}
    median = {r["column"]: r["value"] for r in found.where("probability = 0.5").collect()}
    assert median["x"] == exact["x"]["p50"] == 3.25  # the hot value covers the error
    # A sketch of another distribution is outside the margin.
    off = sketches.ranks_of(df, found.where("column = 'y'").withColumn("value", F.col("value") * 1.2 + 1))
    assert any(not r.below - margin <= r.probability <= r.upto + margin for r in off.collect())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert sketches.quantile_sketches(df, ["v"]).count() == 0
    assert sketches.distinct_estimates(sketches.distinct_sketches(df.where("false"), ["v"]), ["v"]).first()["n_distinct"] == 0


def plain_top(df, columns, k):
    found = {}
    for r in frequencies_of(df, columns).collect():
        found.setdefault(r["column"], []).append((r["value"], r["n"]))
    return sorted((c, v, n, i + 1) for c, rows in found.items() for i, (v, n) in enumerate(rows[:k]))


def result(df):
    return sorted((r["column"], r["value"], r["n"], r["place"]) for r in df.collect())


@pytest.mark.parametrize("k, tracked", [(3, 64), (5, 4096), (1, 64)])
def test_most_frequent_values_are_exact(spark, wide, k, tracked):
    got = result(sketches.top_values(wide, COLUMNS, k, tracked))
    assert got == plain_top(wide, COLUMNS, k)
    assert ("hot", "-1", WIDE_ROWS // 3, 1) in got


def test_ties_and_short_columns(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), (None, 2)], "s string, n int")
    assert result(sketches.top_values(df, ["s", "n"], 2)) == [
        ("n", "1", 2, 1), ("n", "2", 2, 2), ("s", "a", 1, 1), ("s", "b", 1, 2)
    ]
    assert sketches.top_values(df.where("false"), ["s"], 2).count() == 0
    with pytest.raises(ValueError):
        sketches.top_values(df, ["s"], 0)


def test_hot_values_are_counted_without_shuffling_the_others(spark, wide):
    """Of the 60,000 rows of the hot column only the values in the sketch are grouped."""
    rows = wide.select("hot")
    plan_of = lambda: sketches.top_values(rows, ["hot"], 1, 64)
    assert result(plan_of()) == [("hot", "-1", WIDE_ROWS // 3, 1)]
    long = sketches.to_long(rows, [], ["hot"], variable="column", as_type="string")
    assert sketches._tracked(long, 64).count() <= 64


def test_days_as_timestamps(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h),) for h in range(5)], "hour timestamp_ntz")
    found = sketches.distinct_estimates(sketches.distinct_sketches(df, ["hour"]))
    assert found.first()["n_distinct"] == 5
