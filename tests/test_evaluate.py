import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tallyloom.operators import evaluate


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    score = np.round(rng.beta(2, 3, 4000), 3)
    score[:1300] = 0.25  # a third of all rows share one score
    label = (rng.random(4000) < 0.2 + 0.5 * score).astype(int)
    rows = [(int(y), float(s), int(s >= 0.5), int(n)) for y, s, n in zip(label, score, rng.integers(1, 5, 4000))]
    return spark.createDataFrame(rows, "label int, score double, prediction int, n int").cache()


def value(df):
    return df.first()[0]


def brute_auc(rows):
    pos = np.array([s for y, s in rows if y == 1])
    neg = np.array([s for y, s in rows if y == 0])
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc(scored):
    rows = [(r.label, r.score) for r in scored.collect()]
    ours = value(evaluate.roc_auc(scored))
    assert ours == pytest.approx(brute_auc(rows))
    raw = scored.withColumn("rawPrediction", F.col("score"))
    theirs = BinaryClassificationEvaluator(labelCol="label", numBins=0).evaluate(raw)
    assert ours == pytest.approx(theirs)


def test_auc_with_weights(scored):
    rows = [(r.label, r.score) for r in scored.collect() for _ in range(r.n)]
    assert value(evaluate.roc_auc(scored, weight="n")) == pytest.approx(brute_auc(rows))


def test_auc_of_one_class(scored):
    assert value(evaluate.roc_auc(scored.where("label = 1"))) is None
    assert value(evaluate.roc_auc_hard(scored.where("label = 1"))) is None


def test_hard_auc_is_auc_of_the_prediction(scored):
    hard = value(evaluate.roc_auc_hard(scored))
    assert hard == pytest.approx(value(evaluate.roc_auc(scored, score="prediction")))


def test_weights_stand_for_rows(scored):
    repeated = scored.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    for metric in (evaluate.accuracy, evaluate.weighted_f1, evaluate.log_loss, evaluate.roc_auc_hard):
        assert value(metric(scored, weight="n")) == pytest.approx(value(metric(repeated)))
    by_label = lambda df: sorted(map(tuple, df.collect()))
    assert by_label(evaluate.confusion_matrix(scored, weight="n")) == by_label(
        evaluate.confusion_matrix(repeated)
    )


def test_weighted_f1_and_accuracy_equal_the_evaluators(scored):
    df = scored.withColumns({c: F.col(c).cast("double") for c in ("label", "prediction")})
    for metric, ours in (("weightedFMeasure", evaluate.weighted_f1), ("accuracy", evaluate.accuracy)):
        theirs = MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
        assert value(ours(scored)) == pytest.approx(theirs)


def test_log_loss(scored):
    rows = scored.collect()
    loss = -np.mean([np.log(r.score if r.label else 1 - r.score) for r in rows])
    assert value(evaluate.log_loss(scored)) == pytest.approx(loss)


def test_log_loss_is_finite_when_certain_and_wrong(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0)], "label int, score double")
    assert value(evaluate.log_loss(df)) == pytest.approx(-np.log(1e-15), rel=1e-2)


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (0, 0)], "label int, prediction int")
    report = {r["class"]: tuple(r)[1:] for r in evaluate.classification_report(df).collect()}
    assert report["0"] == pytest.approx((0.75, 1.0, 6 / 7, 3))
    assert report["1"] == (0.0, 0.0, 0.0, 1)
    assert report["accuracy"] == pytest.approx((0.75, 0.75, 0.75, 4))
    assert report["macro avg"] == pytest.approx((0.375, 0.5, 3 / 7, 4))
    assert report["weighted avg"] == pytest.approx((0.5625, 0.75, 9 / 14, 4))


def test_confusion_fills_empty_cells(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    assert sorted(tuple(r) for r in evaluate.confusion_matrix(df).collect()) == [(0, 1, 0), (1, 1, 0)]


def test_rounding(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (1.0,)], "score double")
    assert [r[0] for r in df.select(evaluate.rounded("score")).collect()] == [0, 1, 1]


def test_empty(scored):
    nothing = scored.where("false")
    for metric in (evaluate.accuracy, evaluate.weighted_f1, evaluate.log_loss, evaluate.roc_auc):
        assert value(metric(nothing)) is None


def test_rows_without_label_or_score_take_no_part(scored):
    nan = float("nan")
    spark = scored.sparkSession
    bad = [(None, 0.9, 1, 2), (1, None, None, 2), (0, nan, None, 1), (None, None, None, 1)]
    odd = scored.unionByName(spark.createDataFrame(bad, scored.schema))
    for metric in (evaluate.accuracy, evaluate.weighted_f1, evaluate.log_loss, evaluate.roc_auc, evaluate.roc_auc_hard):
        assert value(metric(odd, weight="n")) == pytest.approx(value(metric(scored, weight="n")))
    for table in (evaluate.confusion_matrix, evaluate.classification_report):
        assert sorted(map(tuple, table(odd).collect())) == sorted(map(tuple, table(scored).collect()))


def test_log_loss_of_the_usable_rows_alone(spark):
    df = spark.createDataFrame([(1, 0.9), (1, None), (None, 0.5), (0, float("nan"))], "label int, score double")
    assert value(evaluate.log_loss(df)) == pytest.approx(-np.log(0.9))


def test_three_classes(spark):
    rows = [(0, 0), (1, 2), (2, 2), (2, 1), (1, 1)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    cells = evaluate.confusion_matrix(df, classes=(0, 1, 2)).collect()
    assert sum(sum(tuple(r)[1:]) for r in cells) == len(rows)
    with pytest.raises(Exception, match="is none of"):
        evaluate.confusion_matrix(df).collect()
