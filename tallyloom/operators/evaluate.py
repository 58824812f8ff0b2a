"""Exact evaluation of a binary or multi-class prediction, as aggregates.

``weight`` names a column of row multiplicities, for frames in which equal rows have been
folded into one. Rows whose label, or whose score or prediction, is null or NaN take no part in
any figure, neither above nor below the line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-15


def _weight(weight: str | None) -> Column:
    return F.lit(1) if weight is None else F.col(weight)


def usable(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value, and a number, in all of the columns."""
    for name in columns:
        df = df.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
    return df


def rounded(score: str) -> Column:
    """A score as a 0/1 label, or a numeric label as an integer."""
    return F.round(F.col(score)).cast("int")


def confusion_matrix(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    classes: Sequence[int] = (0, 1),
    weight: str | None = None,
) -> DataFrame:
    """Rows per label and predicted class; an empty cell is 0.

    A label or prediction that is none of ``classes`` raises an error when the result is
    computed: it would be counted nowhere.
    """
    df = usable(df, label, prediction)
    unknown = F.raise_error(F.lit(f"{label} or {prediction} is none of {tuple(classes)}"))
    known = F.col(label).isin(*classes) & F.col(prediction).isin(*classes)
    df = df.withColumn(prediction, F.when(known, F.col(prediction)).otherwise(unknown))
    cells = [
        F.coalesce(F.sum(F.when(F.col(prediction) == c, _weight(weight))), F.lit(0)).alias(
            f"predicted_{c}"
        )
        for c in classes
    ]
    return df.groupBy(label).agg(*cells)


def accuracy(
    df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    w = _weight(weight)
    hit = F.coalesce(F.sum(F.when(F.col(label) == F.col(prediction), w)), F.lit(0))
    return usable(df, label, prediction).agg(F.try_divide(hit, F.sum(w)).alias("accuracy"))


def _by_class(df: DataFrame, label: str, prediction: str, weight: str | None) -> DataFrame:
    """Support, predictions and hits per class, then precision, recall and F1.

    A ratio over nothing is 0. Folding to (label, prediction) cells first leaves a handful
    of rows for everything that follows.
    """
    df = usable(df, label, prediction)
    cells = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.sum(_weight(weight)).alias("n")
    )
    zero, n = F.lit(0), F.col("n")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").cast("int").alias("class"), n.alias("support"),
                 zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").cast("int").alias("class"), zero.alias("support"),
                 n.alias("predicted"), zero.alias("hits")),
    )
    totals = cells.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hits = F.col("hits")
    return totals.select(
        "class",
        ratio(hits, F.col("predicted")).alias("precision"),
        ratio(hits, F.col("support")).alias("recall"),
        ratio(2 * hits, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def _weighted(column: str) -> Column:
    return F.try_divide(F.sum(F.col(column) * F.col("support")), F.sum("support"))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    table = _by_class(df, label, prediction, weight)
    right = F.try_divide(F.sum("hits"), F.sum("support"))
    lines = table.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), right.alias("precision"),
                     right.alias("recall"), right.alias("f1"), F.sum("support").alias("support")),
            F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                     F.sum("support").alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), _weighted("precision").alias("precision"),
                     _weighted("recall").alias("recall"), _weighted("f1").alias("f1"),
                     F.sum("support").alias("support")),
        ).alias("lines")
    ).select(F.inline("lines"))
    classes = table.select(F.col("class").cast("string"), "precision", "recall", "f1", "support")
    return classes.unionByName(lines)


def weighted_f1(
    df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    """F1 per class averaged by support."""
    return _by_class(df, label, prediction, weight).agg(_weighted("f1").alias("weighted_f1"))


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "score", weight: str | None = None
) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in the right order,
    ties counting half. Null when a class is missing.

    Scores are folded to their distinct values and cut into ranges. Each range works out its
    own pairs; pairs across ranges follow from the ranges' totals alone.
    """
    w = _weight(weight)
    by_score = usable(df, label, score).groupBy(F.col(score).alias("score")).agg(
        F.coalesce(F.sum(F.when(F.col(label) == 1, w)), F.lit(0)).cast("double").alias("pos"),
        F.coalesce(F.sum(F.when(F.col(label) == 0, w)), F.lit(0)).cast("double").alias("neg"),
    )
    ranges = by_score.repartitionByRange("score").withColumn("part", F.spark_partition_id())
    lower = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("pos") * (F.coalesce(F.sum("neg").over(lower), F.lit(0.0)) + F.col("neg") / 2)
    # One row per range from here on.
    parts = (
        ranges.withColumn("pairs", pairs)
        .groupBy("part")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("pairs"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    return parts.withColumn("pairs", F.col("pairs") + across).agg(
        F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("auc_score")
    )


def roc_auc_hard(
    df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    """The same area on 0/1 predictions, which is the mean of both classes' recall."""
    w = _weight(weight)
    y, p = F.col(label), F.col(prediction)
    recall = lambda c: F.try_divide(
        F.coalesce(F.sum(F.when((y == c) & (p == c), w)), F.lit(0)), F.sum(F.when(y == c, w))
    )
    return usable(df, label, prediction).agg(((recall(1) + recall(0)) / 2).alias("auc_hard"))


def log_loss(
    df: DataFrame, label: str = "label", score: str = "score", weight: str | None = None
) -> DataFrame:
    """Mean negative log likelihood of the labels (0 or 1), scores clipped away from 0 and 1."""
    df = usable(df, label, score)
    w = _weight(weight)
    p = F.least(F.greatest(F.col(score), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return df.agg(F.try_divide(F.sum(w * loss), F.sum(w)).alias("log_loss"))
