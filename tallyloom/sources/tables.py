"""Bindings of the test tables to the roles the operators work on.

Each returns a lazy frame; columns a query does not use never leave the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.calendar import hour_start, with_calendar
from tallyloom.functions.hashing import hashes_below, stable_hash

YEARS = tuple(range(1995, 2002))
YEAR_COLUMNS = tuple(f"y{year}" for year in YEARS)
MONEY = "decimal(18,2)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def impressions(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as a click log, with calendar columns."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    log = events.select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "click").alias("click"),
        hour_start("ts").alias("hour"),
        k.alias("C1"),
        (user % 7).cast("int").alias("banner_pos"),
        F.concat(F.lit("site_"), (k % 6).cast("string")).alias("site_category"),
        F.concat(F.lit("app_"), (k % 9).cast("string")).alias("app_category"),
        (user % 5).cast("int").alias("device_type"),
        (k % 4).cast("int").alias("device_conn_type"),
        (k % 10).cast("int").alias("C15"),
        (k % 8).cast("int").alias("C16"),
        (k % 3).cast("int").alias("C18"),
    )
    return with_calendar(log)


#: Share of clicks in the planted log, and what a site and the evening add to it.
PLANTED_RATE, PLANTED_SITE, PLANTED_EVENING = 0.1, 0.5, 0.2
PLANTED_SEED = 7


def planted_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The click log with clicks by a rule that models can find: one site and the evening have more."""
    site, evening = F.col("site_category") == "site_1", F.col("hour_in_day") >= 18
    below = lambda share: F.lit(hashes_below(round(share, 6)))
    both = F.when(site & evening, below(PLANTED_RATE + PLANTED_SITE + PLANTED_EVENING))
    limit = both.when(site, below(PLANTED_RATE + PLANTED_SITE)).when(evening, below(PLANTED_RATE + PLANTED_EVENING))
    rate = limit.otherwise(below(PLANTED_RATE))
    return impressions(spark, folder).withColumn("click", stable_hash("id", PLANTED_SEED) < rate)


def event_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of the event stream, with calendar columns and the code C1."""
    events = table(spark, folder, "events").select(
        "value", "user_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("C1")
    )
    return with_calendar(events, "ts")


def line_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The large click log: line items, with the keys of the part and order they belong to."""
    lines = table(spark, folder, "lineitem")
    log = lines.select(
        (F.col("l_returnflag") == "R").alias("click"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("hour"),
        F.col("l_linenumber").alias("banner_pos"),
        (F.col("l_suppkey") % 5).cast("int").alias("device_type"),
        F.col("l_partkey").alias("part"),
        F.col("l_orderkey").alias("order"),
    )
    return with_calendar(log)


def app_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup of the large log: category of a part."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_type").alias("app_category")
    )


def site_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup of the large log: category of an order."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("site_category")
    )


def region_year(spark: SparkSession, folder: str, years: Sequence[int] = YEARS) -> DataFrame:
    """One row per region and one money column for each of the years.

    Orders of other years belong to no column; :func:`orders_outside` tells of them.

    Orders are folded by customer before they meet the customer table: a customer with a
    third of all orders is one row by then, and the join needs no second shuffle.
    """
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice").cast(MONEY)
    year = F.year("o_orderdate")
    names = [f"y{y}" for y in years]
    yearly = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *[F.sum(F.when(year == y, price)).alias(c) for y, c in zip(years, names)]
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    by_nation = (
        yearly.join(customers, "c_custkey")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(*[F.sum(c).alias(c) for c in names])
    )
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        by_nation.join(nations, "n_nationkey")
        .groupBy(F.col("n_name").alias("district"))
        .agg(*[F.sum(c).cast("double").alias(c) for c in names])
    )


def orders_outside(spark: SparkSession, folder: str, years: Sequence[int] = YEARS) -> DataFrame:
    """``orders`` and ``total`` that no year of the regional table holds (no year at all included),
    beside ``all_orders``: one row."""
    outside = ~F.coalesce(F.year("o_orderdate").isin(*years), F.lit(False))
    price = F.col("o_totalprice").cast(MONEY)
    return table(spark, folder, "orders").agg(
        F.count_if(outside).alias("orders"),
        F.coalesce(F.sum(F.when(outside, price)), F.lit(0)).cast("double").alias("total"),
        F.count(F.lit(1)).alias("all_orders"),
    )


def with_rollup(df: DataFrame, key: str = "district", name: str = "ALL") -> DataFrame:
    """Add one row with the mean of every column, to the cent."""
    means = [F.round(F.avg(c), 2).alias(c) for c in df.columns if c != key]
    return df.unionByName(df.agg(*means).withColumn(key, F.lit(name)))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score and a prediction made by rule."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    score = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 2000.0))
    return (
        documents.join(labels, "doc_id")
        .withColumn("score", score)
        .withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    )
