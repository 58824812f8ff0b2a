import zlib

import numpy as np
import pytest
from awkward import documents, none
from pyspark.sql import functions as F

from tallyloom.llm import quality
from tallyloom.llm.quality import good_documents, isotonic, quality_report, statistics
from tallyloom.operators.evaluate import roc_auc
from tallyloom.sources.tables import table

FOLDER = "/root/testdata/sf0.1"


def test_held_out_ranking(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    scored = quality_report(docs, labels).join(labels, "doc_id").filter("held_out")
    assert roc_auc(scored, "quality", "score").first()[0] > 0.9
    good = scored.filter("quality = 1")
    assert good.agg(F.avg("predicted")).first()[0] > 0.97
    assert scored.filter("quality = 0").agg(F.avg("predicted")).first()[0] < 0.4


def test_isotonic_is_the_best_rising_curve():
    x = np.arange(6) / 6
    at, to = isotonic(x, np.array([0.0, 0.5, 0.2, 0.2, 0.9, 0.8]), np.array([1.0, 1, 1, 2, 1, 3]))
    assert list(np.round(to, 6)) == [0.0, 0.275, 0.825]
    assert (np.diff(at) > 0).all()


def test_statistics_are_finite():
    for text in ("", " ", "\n\n", "a", "\x00", "é" * 10, "!" * 100_000, "\ud800"):
        assert np.isfinite(statistics(text)).all()
    assert len(statistics("x")) == len(quality.STATISTICS)


def labels_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    return df.withColumn("stats", F.lit("mine"))


@pytest.mark.parametrize(
    "rows",
    [[], [(1, None, 0)], [(i, 1, 0) for i in range(12)], [(i, i % 2, 0) for i in range(12)] + [(1, 0, 0), (None, 1, 0)]],
)
def test_awkward_rows(spark, rows):
    docs, labels = documents(spark), labels_of(spark, rows)
    got = quality_report(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in got)
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)
    assert quality_report(none(docs), labels).count() == good_documents(none(docs), labels).count() == 0


def rising_by_hand(y, w):
    """The rising curve nearest to y: at each place the greatest over all starts of the least mean."""
    mean = lambda a, b: sum(y[i] * w[i] for i in range(a, b + 1)) / sum(w[a : b + 1])
    n = len(y)
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_by_hand():
    dice = np.random.default_rng(2)
    for _ in range(30):
        n = int(dice.integers(1, 12))
        y, w = dice.random(n), dice.integers(1, 5, n).astype(float)
        at, to = isotonic(np.arange(n, dtype=float), y, w)
        wanted = rising_by_hand(list(y), list(w))
        assert set(np.round(to, 9)) == set(np.round(wanted, 9))
        assert (np.diff(to) > 0).all() and (np.diff(at) > 0).all()


def test_scores_are_those_of_one_matrix(spark):
    """All rows in one table: the same weights by least squares, the same curve, the same scores."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    said = {r.doc_id: r.quality for r in labels.collect()}
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    learned = [i for i in said if crc(i, 5) and i in text]
    stats = np.array([statistics(text[i]) for i in learned])
    y = np.array([float(said[i]) for i in learned])
    shapes = np.array([crc(i, 5) == 1 for i in learned])

    model = quality.fit(quality._examples(quality.with_statistics(docs), labels))
    scale = stats.std(axis=0)
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, np.where(scale < 1e-9, 1, scale))
    waves = np.cos(((stats - model.mean) / model.scale).clip(-6, 6) @ model.directions + model.phases) * np.sqrt(2 / quality.N_FOURIER)
    z = np.hstack([waves, np.ones((len(y), 1))])
    # Ridge as plain least squares: the penalty is one more row per weight.
    tall = np.vstack([z[~shapes], np.sqrt(quality.RIDGE) * np.eye(z.shape[1])])
    weights = np.linalg.lstsq(tall, np.append(y[~shapes], np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(model.weights, weights, atol=1e-6)

    raw = (z @ weights).clip(0, 1)
    bins = np.minimum(quality.BINS - 1, (raw[shapes] * quality.BINS).astype(int))
    places = sorted(set(bins))
    mean = [y[shapes][bins == b].mean() for b in places]
    size = [float((bins == b).sum()) for b in places]
    wanted = rising_by_hand(mean, size)
    got = {r.doc_id: r.score for r in quality_report(docs, labels).collect()}
    assert len(got) == len(text)
    centres, values = [], []
    for v in sorted(set(np.round(wanted, 12))):
        of = [k for k, x in enumerate(np.round(wanted, 12)) if x == v]
        centres.append(sum((places[k] + 0.5) / quality.BINS * size[k] for k in of) / sum(size[k] for k in of))
        values.append(v)
    for i in list(text)[:300]:
        one = np.cos(((statistics(text[i])[None] - model.mean) / model.scale).clip(-6, 6) @ model.directions + model.phases)
        score = float((np.append(one * np.sqrt(2 / quality.N_FOURIER), 1.0) @ weights).clip(0, 1))
        assert abs(got[i] - np.interp(score, centres, values)) < 1e-5
