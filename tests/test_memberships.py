import pytest
from pyspark.sql import functions as F

from tallyloom.operators import classes, memberships

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Keys beyond one bitmap, one with two rows, one null; nulls are no class."""
    i = F.col("id")
    level = lambda n: F.when(i % n == 0, "High").when(i % (n * 5 + 1) == 3, None).otherwise("Low")
    df = spark.range(40_000).select(F.concat(F.lit("k"), i).alias("key"), level(2).alias("a"), level(3).alias("b"), level(5).alias("c"))
    more = spark.createDataFrame([("k1", "High", "High", "High"), (None, "High", "High", "High")], "key string, a string, b string, c string")
    return df.unionByName(more).cache()


def keys(df):
    found = [r[0] for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_sets_are_those_of_joins(table):
    numbers = memberships.key_numbers(table, "key")
    bitmaps = memberships.class_bitmaps(table, numbers, "key", COLUMNS)
    named = table.where("key IS NOT NULL")
    sets = [classes.members(named, "key", c, "High") for c in COLUMNS]
    every = memberships.members_of(memberships.in_every(bitmaps, [(c, "High") for c in COLUMNS]), numbers, "key")
    assert keys(every) == keys(classes.in_all(sets)) and "k1" in keys(every) and len(keys(every)) > 1000
    any_ = memberships.members_of(memberships.in_any(bitmaps, [("a", "High"), ("b", "Low")]), numbers, "key")
    assert keys(any_) == keys(named.where("a = 'High' OR b = 'Low'").select("key").distinct())
    sizes = {(r["column"], r["class"]): r.n for r in memberships.class_sizes(bitmaps).collect()}
    assert sizes["b", "High"] == keys(sets[1].distinct()).__len__()
    assert bitmaps.where("bucket > 1").count() > 0


def test_one_aggregate_over_the_rows(table):
    numbers = memberships.key_numbers(table, "key")
    bitmaps = memberships.class_bitmaps(table, numbers, "key", COLUMNS)
    plan = memberships.in_every(bitmaps, [(c, "High") for c in COLUMNS])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "Cartesian" not in plan


def test_sets_of_nothing(table):
    numbers = memberships.key_numbers(table, "key")
    bitmaps = memberships.class_bitmaps(table, numbers, "key", COLUMNS)
    assert memberships.in_every(bitmaps, [("a", "High"), ("a", "none")]).count() == 0
    empty = table.where("false")
    none = memberships.class_bitmaps(empty, memberships.key_numbers(empty, "key"), "key", COLUMNS)
    assert none.count() == memberships.class_sizes(none).count() == 0
