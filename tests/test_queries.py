"""Every registered query against its SQL on the smallest tables."""

import pytest
from comparing import database, differences

import __spark_entry__ as entry
from tallyloom.catalog import oracle, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.oracle_sql()
BY_MODEL = {
    "selected_features",
    "lr_predictions",
    "lr_ridge_predictions",
    "penalty_path",
    "gbt_predictions",
    "rf_predictions",
    "saved_lr_predictions",
    "click_model_metrics",
}


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_only_model_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == BY_MODEL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, SQL[name]) == ""


def test_entry_has_all_of_them():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["hour_in_day", "clicks", "impressions", "rate"]
    assert df.count() > 0
