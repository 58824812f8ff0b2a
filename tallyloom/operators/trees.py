"""Tree models as tables: the nodes a written model holds, scores worked out from them, and what
must hold of a fit.

Rows walk down all trees at once, a level per join with the nodes (which have the size of the
model). Nothing of the rows passes through the driver.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW, TREE, NODE = "_row", "tree", "node"


def tree_table(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a boosted model or a forest that was written to ``path``.

    ``tree`` and ``node`` name a node; ``left`` and ``right`` are its children (null for a leaf),
    ``feature`` the slot it looks at; a row goes left if its value is at most ``threshold``, or one
    of ``categories``. ``prediction`` is the leaf's value, ``share`` the weighted share of label 1
    (classification trees), ``weight`` that of the tree.
    """
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias(TREE), "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias(TREE), F.col("_3").alias("weight"))
    inner, numeric = F.col("leftChild") >= 0, F.col("split.numCategories") < 0
    values, stats = F.col("split.leftCategoriesOrThreshold"), F.col("impurityStats")
    return nodes.join(F.broadcast(weights), TREE).select(
        TREE, F.col("id").alias(NODE),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & numeric, F.get(values, F.lit(0))).alias("threshold"),
        F.when(inner & ~numeric, values).alias("categories"),
        "prediction",
        F.try_divide(F.get(stats, F.lit(1)), F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)).alias("share"),
        "weight",
    )


def with_leaves(rows: DataFrame, trees: DataFrame, depth: int, features: str = "features") -> DataFrame:
    """Every row once for every tree, with the ``node`` it ends in, that leaf's ``prediction``,
    ``share`` and the tree's ``weight``; ``_row`` numbers the rows."""
    count = trees.agg(F.max(TREE) + 1).scalar()
    state = rows.withColumns(
        {"_x": vector_to_array(features), ROW: F.monotonically_increasing_id()}
    ).drop(features)
    state = state.withColumn(TREE, F.explode(F.sequence(F.lit(0), count - 1))).withColumn(NODE, F.lit(0))
    splits = F.broadcast(trees.select(TREE, NODE, "left", "right", "feature", "threshold", "categories"))
    value = F.get("_x", F.col("feature"))
    goes_left = F.when(F.col("threshold").isNotNull(), value <= F.col("threshold")).otherwise(
        F.array_contains("categories", value)
    )
    following = F.when(F.col("left").isNull(), F.col(NODE)).otherwise(F.when(goes_left, F.col("left")).otherwise(F.col("right")))
    for _ in range(depth):
        state = state.join(splits, [TREE, NODE]).withColumn("_next", following)
        state = state.drop(NODE, "left", "right", "feature", "threshold", "categories").withColumnRenamed("_next", NODE)
    leaves = F.broadcast(trees.select(TREE, NODE, "prediction", "share", "weight"))
    return state.drop("_x").join(leaves, [TREE, NODE])


def _share(margin: Column) -> Column:
    """The probability of label 1 that a margin of the boosted model stands for."""
    return 1 / (1 + F.exp(-2 * margin))


def boosted_scores(walked: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``score`` of every row, from the leaves of a boosted model."""
    margin = F.sum(F.col("weight") * F.col("prediction"))
    return walked.groupBy(ROW, *columns).agg(_share(margin).alias("score")).drop(ROW)


def forest_scores(walked: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``score`` of every row, from the leaves of a forest."""
    return walked.groupBy(ROW, *columns).agg(F.avg("share").alias("score")).drop(ROW)


def boosted_leaves(walked: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """``tree``, ``node``, its ``prediction`` and the ``mean`` it must have: that of the log-loss's
    slope at its training rows, after the trees before (of the labels themselves, -1 and 1, in the
    first tree)."""
    earlier = Window.partitionBy(ROW).orderBy(TREE).rowsBetween(Window.unboundedPreceding, -1)
    margin = F.coalesce(F.sum(F.col("weight") * F.col("prediction")).over(earlier), F.lit(0.0))
    sign = 2.0 * F.col(label) - 1
    slope = F.when(F.col(TREE) == 0, sign).otherwise(4 * sign / (1 + F.exp(2 * sign * F.col("_margin"))))
    rows = walked.withColumn("_margin", margin).withColumn("_slope", slope)
    mean = F.sum(F.col(n) * F.col("_slope")) / F.sum(n)
    return rows.groupBy(TREE, NODE, "prediction").agg(mean.alias("mean"))


def boosted_losses(walked: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """``tree`` and the log-loss (``loss``) of the model that ends with it."""
    upto = Window.partitionBy(ROW).orderBy(TREE).rowsBetween(Window.unboundedPreceding, 0)
    rows = walked.withColumn("_margin", F.sum(F.col("weight") * F.col("prediction")).over(upto))
    share = _share(F.col("_margin"))
    loss = -F.ln(F.when(F.col(label) == 1, share).otherwise(1 - share))
    return rows.groupBy(TREE).agg((F.sum(F.col(n) * loss) / F.sum(n)).alias("loss"))


def forest_leaves(walked: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """``tree``, ``node``, its ``share`` of label 1, and the ``mean`` and number (``rows``) of the
    training rows that end there. A tree is grown on a sample, so the two differ by chance."""
    mean = F.sum(F.col(n) * F.col(label)) / F.sum(n)
    return walked.groupBy(TREE, NODE, "share").agg(mean.alias("mean"), F.sum(n).alias("rows"))
