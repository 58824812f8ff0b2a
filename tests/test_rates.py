import pytest
from pyspark.sql import functions as F

from tallyloom.operators import rates


@pytest.fixture
def log(spark):
    rows = [
        ("a", True, 1), ("a", False, 1), ("a", False, 2), ("a", True, 3),
        ("b", False, 1), ("b", False, 2),
        ("c", True, 1),
        ("d", True, 4), ("d", None, 4), ("d", False, 4),
        (None, True, 1), (None, False, 2),
    ]
    return spark.createDataFrame(rows, "k string, click boolean, other int")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rates_leave_out_null_keys_and_keys_without_clicks(log):
    # d has three rows, one of them of unknown outcome
    assert rows(rates.click_rates(log, "k")) == [
        ("c", 1, 1, 100.0), ("a", 2, 4, 50.0), ("d", 1, 2, 50.0),
    ]


def test_totals_stay_with_their_key_when_a_key_has_no_click(log):
    # b has no clicks; what stands in its place among the clicked keys must not get its total
    totals = {r["k"]: r["impressions"] for r in rates.click_rates(log, "k").collect()}
    assert totals == {"a": 4, "c": 1, "d": 2}


def test_joined_form_is_the_same(log):
    assert rows(rates.click_rates_joined(log, "k")) == rows(rates.click_rates(log, "k"))


def test_integer_clicks(log):
    as_int = log.withColumn("click", F.col("click").cast("int"))
    assert rows(rates.click_rates(as_int, "k")) == rows(rates.click_rates(log, "k"))


def test_rates_read_the_table_once(log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    df = rates.click_rates(log.sparkSession.read.parquet(str(tmp_path / "log")), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "other" not in plan
    assert "Python" not in plan
    assert "IsNotNull(k)" in plan


def test_shares_count_nulls_in_the_whole_only(spark):
    df = spark.createDataFrame([(True,), (False,), (False,), (None,)], "click boolean")
    assert sorted(rows(rates.shares(df, "click"))) == [(False, 2, 0.5), (True, 1, 0.25)]


def test_shares_scan_once(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("x")).write.parquet(str(tmp_path / "t"))
    df = rates.shares(spark.read.parquet(str(tmp_path / "t")), "x")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_crosstab_empty_cells_are_null(log):
    found = {r[0]: tuple(r)[1:] for r in rates.crosstab(log, "k", values=rates.BY_CLICK).collect()}
    assert found == {"a": (2, 2), "b": (2, None), "c": (None, 1), "d": (1, 1)}


def test_crosstab_finds_its_values(log):
    table = rates.crosstab(log, "k", "other")
    assert table.columns == ["k", "1", "2", "3", "4"]
    total = table.agg(*[F.sum(c) for c in table.columns[1:]]).first()
    assert sum(total) == log.where("k IS NOT NULL").count()


def test_crosstab_cells_sum_to_rows(log):
    complete = log.na.drop()
    table = rates.crosstab(complete, "k", values=rates.BY_CLICK)
    assert table.agg(F.sum("click") + F.sum("no_click")).first()[0] == complete.count()


def test_crosstab_shares(log):
    found = {r[0]: tuple(r)[1:] for r in rates.crosstab_shares(log, "k").collect()}
    assert found == {"a": (0.5, 0.5), "b": (1.0, None), "c": (None, 1.0), "d": (0.5, 0.5)}


def test_frequencies_break_ties_by_value(spark):
    df = spark.createDataFrame([("y",), ("x",), ("z",), ("z",), (None,)], "v string")
    assert rows(rates.frequencies(df, "v")) == [("z", 2), ("x", 1), ("y", 1)]


def test_frequencies_of_mixed_types(log):
    table = rates.frequencies_of(log, ["k", "other"])
    assert rows(table.where("column = 'other' AND n > 2")) == [("other", "1", 5), ("other", "2", 3), ("other", "4", 3)]


def test_nan_key_is_no_key(spark):
    df = spark.createDataFrame([(1.0, True), (float("nan"), True), (None, True)], "k double, click boolean")
    assert rows(rates.click_rates(df, "k")) == [(1.0, 1, 1, 100.0)]


def test_summary_equals_single_tables(log):
    table = rates.rate_summary(log, {"by_k": "k", "by_other": "other"}, total="everything")
    for chart, key in {"by_k": "k", "by_other": "other"}.items():
        mine = sorted(rows(table.where(F.col("chart") == chart).drop("chart")))
        single = rates.click_rates(log, key).withColumn(key, F.col(key).cast("string"))
        assert mine == sorted(rows(single))
    assert rows(table.where("chart = 'everything'").drop("chart")) == [
        ("all", 5, 11, pytest.approx(500 / 11))
    ]


def test_rates_through_a_lookup(spark):
    facts = spark.createDataFrame(
        [(1, True), (1, False), (2, True), (3, False), (9, True), (None, True)], "f int, click boolean"
    )
    lookup = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "id int, name string")
    through = rates.click_rates_through(facts, "f", lookup, "id", "name")
    plain = rates.click_rates(facts.join(lookup, facts.f == lookup.id), "name")
    assert rows(through) == rows(plain) == [("x", 2, 3, pytest.approx(200 / 3))]


def test_keys_by_rate(log):
    assert rows(rates.keys_by_rate(log, "k")) == [(1, "c", 100.0), (2, "a", 50.0), (3, "d", 50.0)]


def test_empty_input(log):
    nothing = log.where("false")
    assert rows(rates.click_rates(nothing, "k")) == []
    assert rows(rates.crosstab(nothing, "k", values=rates.BY_CLICK)) == []
    assert rows(rates.shares(nothing, "click")) == []
    assert rows(rates.rate_summary(nothing, {"k": "k"}, total="all")) == []
