import numpy as np
import pytest
from awkward import CLASHING
from pyspark.sql import functions as F

from tallyloom.llm import nearest
from tallyloom.llm.nearest import nearest_report, search
from tallyloom.sources.tables import table


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return df.withColumns({name: F.lit("mine") for name in [*CLASHING, "vid", "ids", "lists", "asks"]})


def by_hand(rows, is_query, k=10):
    rows = [(i, np.float32(v).astype(np.float64)) for i, v in rows]
    found = []
    for q, v in rows:
        if is_query(q):
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in rows if i != q)[:k]
            found += [(q, n + 1, i, s) for n, (s, i) in enumerate(near)]
    return sorted(found)


def recall(got, wanted):
    return len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in wanted}) / max(1, len(wanted))


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    got = result(search(frame(spark, rows), F.col("vec_id") % 10 == 0))
    wanted = by_hand(rows, lambda i: i % 10 == 0)
    assert len(got) == len(wanted)
    assert recall(got, wanted) >= 0.9
    vectors = {i: np.float64(np.float32(v)) for i, v in rows}
    for q, _, i, s in got:
        assert s == pytest.approx(float(np.linalg.norm(vectors[q] - vectors[i])), abs=1e-12)


def test_lists_in_parts_give_the_same(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    first = result(nearest_report(frame(spark, rows)))
    monkeypatch.setattr(nearest, "GROUP_ROWS", 3)
    parts = result(nearest_report(frame(spark, rows)))
    assert recall(parts, first) >= 0.95


def test_copies_and_ties(spark):
    dice = np.random.default_rng(5)
    base = dice.normal(size=(4, 8)).round(2).tolist()
    rows = [(i, base[0] if i < 90 else base[i % 4]) for i in range(130)]
    got = result(search(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert got == by_hand(rows, lambda i: i % 50 == 0)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    bad = [(200, None), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [0.0, 0.0]), (600, [1.0, None]),
           (700, []), (800, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    got = result(nearest_report(frame(spark, good + bad)))
    assert [r[:3] for r in got] == [(100, 1, 2), (100, 2, 1)]


def test_few_and_no_rows(spark):
    assert result(nearest_report(frame(spark, [(100, [1.0, 0.0])]))) == []
    assert result(nearest_report(frame(spark, []))) == []
    assert result(nearest_report(frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0])]))) == []


def test_repeated_rows_hide_no_neighbour(spark):
    """One id twenty times and fourteen others with the query's own vector."""
    dice = np.random.default_rng(8)
    own, far = dice.normal(size=8).round(2).tolist(), dice.normal(size=(40, 8)).round(2).tolist()
    rows = [(100, own), *[(1, own)] * 20, *[(i, own) for i in range(2, 16)], *[(200 + 7 * i, v) for i, v in enumerate(far)]]
    got = result(search(frame(spark, rows), F.col("vec_id") == 100))
    assert [r[2] for r in got] == list(range(1, 11)) and {r[3] for r in got} == {0.0}
    assert got == by_hand(sorted(set((i, tuple(v)) for i, v in rows)), lambda i: i == 100)


def test_one_id_with_two_vectors(spark):
    rows = [(100, [1.0, 0.0]), (5, [1.0, 0.1]), (5, [0.0, 1.0]), (6, [0.9, 0.0]), (7, [-1.0, 0.0])]
    got = [r[1:3] for r in result(search(frame(spark, rows), F.col("vec_id") == 100, neighbours=4))]
    assert got == [(1, 5), (2, 6), (3, 5), (4, 7)]


def test_short_answers_are_filled(spark, monkeypatch):
    """With one list looked into at first, queries of small outlying groups go on to others."""
    dice = np.random.default_rng(9)
    rows = [(i, (dice.normal(size=6) + 40 * (i % 30)).round(3).tolist()) for i in range(150)]
    monkeypatch.setattr(nearest, "RECALL", 0.0)
    got = result(search(frame(spark, rows), F.col("vec_id") % 10 == 0))
    assert len(got) == 15 * 10
    few = rows[:8]
    got = result(search(frame(spark, few), F.col("vec_id") % 2 == 0))
    assert got == by_hand(few, lambda i: i % 2 == 0) and len(got) == 4 * 7


def test_lists_on_a_tree(spark, monkeypatch):
    """More lists than one level may have, and lists and questions cut into parts."""
    monkeypatch.setattr(nearest, "FLAT_LISTS", 10)
    monkeypatch.setattr(nearest, "FIT_ROWS", 8)
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    wanted = by_hand(rows, lambda i: i % 20 == 0)
    for group in (4096, 5):
        monkeypatch.setattr(nearest, "GROUP_ROWS", group)
        got = result(search(frame(spark, rows), F.col("vec_id") % 20 == 0))
        assert len(got) == len(wanted) and recall(got, wanted) >= 0.9
    index = nearest.fit(nearest.distinct_vectors(frame(spark, rows).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), 11), len(rows))
    assert index.tops is not None and len(index.centroids) > 30 and index.ends[-1] == len(index.centroids)
