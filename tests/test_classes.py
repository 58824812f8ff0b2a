import pytest
from pyspark.sql import functions as F

from tallyloom.operators import classes, rates, reshape
from tallyloom.plans import regions
from tallyloom.sources.tables import with_rollup


@pytest.fixture
def table(spark):
    # invented rows; means are 20 and 4.0333...
    rows = [("north", 10, 1.1), ("south", 20, 3.0), ("east", 30, 8.0), ("west", 20, None)]
    return spark.createDataFrame(rows, "district string, y1 int, y2 double")


def classed(df, *columns):
    return {r["district"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_value_on_the_threshold_is_high(table):
    out = classes.classify(table, {"y1": 20}, "Low", "High")
    assert classed(out, "class_y1") == {
        "north": ("Low",), "south": ("High",), "east": ("High",), "west": ("High",),
    }


def test_mean_threshold_and_missing_value(table):
    out = classes.classify(table, {"y1": "mean", "y2": "mean"}, "Low", "High", {"y2": "second"})
    assert classed(out, "class_y1", "second") == {
        "north": ("Low", "Low"), "south": ("High", "Low"), "east": ("High", "High"),
        "west": ("High", "High"),
    }


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", float("nan"))], "district string, v double")
    out = classes.classify(df, {"v": "mean"}, "Low", "High")
    assert classed(out, "class_v") == {"a": ("Low",), "b": ("High",), "c": ("High",)}


def test_rollup_row_on_the_cut_mean_is_high(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.6)], "district string, v double")
    out = classes.classify(with_rollup(df), {"v": "mean"}, "Low", "High", decimals=4)
    assert classed(out, "class_v")["ALL"] == ("High",)


def test_members(table):
    out = classes.classify(table, {"y1": 20}, "Low", "High")
    assert [r[0] for r in classes.first_members(out, "district", "class_y1", "High", 2).collect()] == ["east", "south"]
    assert [r[0] for r in classes.members(out, "district", "class_y1", "Low").collect()] == ["north"]


def test_intersections_agree(table):
    out = classes.classify(table, {"y1": 20, "y2": 3.0}, "Low", "High")
    sets = [classes.members(out, "district", c, "High") for c in ("class_y1", "class_y2")]
    together = {r[0] for r in classes.in_all(sets).collect()}
    assert together == {"south", "east", "west"}
    always = classes.always(out, "district", ["class_y1", "class_y2"], "High")
    assert {r[0] for r in always.collect()} == together


def test_keep_common(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 4), ("z", 5)], "k string, v int")
    kept = classes.keep_common({"a": a, "b": b}, "k")
    assert [tuple(r) for r in kept.orderBy("k", "v").collect()] == [("x", 1, "a"), ("x", 3, "a"), ("x", 4, "b")]


def test_long_and_back(table):
    complete = table.select("district", F.col("y1").cast("double").alias("y1"), "y2").na.drop()
    long = reshape.to_long(complete, ["district"], ["y1", "y2"])
    back = long.groupBy("district").pivot("variable", ["y1", "y2"]).agg(F.first("value"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in complete.collect()}


def test_series_in_order(table):
    found = [tuple(r) for r in reshape.series(table, "district", ["y1"]).collect()]
    assert found == [("east", "y1", 30), ("north", "y1", 10), ("south", "y1", 20), ("west", "y1", 20)]


def test_transpose(table):
    wide = reshape.transpose(table.withColumn("y1", F.col("y1").cast("double")), "district", ["y1", "y2"])
    assert wide.columns == ["variable", "east", "north", "south", "west"]
    assert [tuple(r) for r in wide.orderBy("variable").collect()] == [
        ("y1", 30.0, 10.0, 20.0, 20.0), ("y2", 8.0, 1.1, 3.0, None),
    ]
    some = reshape.transpose(table, "district", ["y1"], names=["west", "east"])
    assert some.columns == ["variable", "west", "east"]


def test_transpose_loses_no_row(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "k string, v int")
    assert [r.asDict() for r in reshape.transpose(df, "k", ["v"]).collect()] == [
        {"variable": "v", "a": 1, "b": None, "null": 2}
    ]
    twice = df.unionByName(df.limit(1))
    with pytest.raises(Exception, match="a value is repeated"):
        reshape.transpose(twice, "k", ["v"]).collect()


def test_class_sizes(table):
    out = regions.classes(table, ["y1", "y2"], regions.RAINFALL, {"y1": 20})
    sizes = rates.frequencies_of(out, ["class_y1", "class_y2"])
    assert [tuple(r) for r in sizes.collect()] == [
        ("class_y1", "High Rainfall Region", 3), ("class_y1", "Low Rainfall Region", 1),
        ("class_y2", "High Rainfall Region", 2), ("class_y2", "Low Rainfall Region", 2),
    ]
