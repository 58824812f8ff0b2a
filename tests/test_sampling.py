import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.hashing import hashes_below, stable_hash
from tallyloom.operators import sampling


@pytest.fixture(scope="module")
def log(spark):
    # A third of the rows share one label; one label has a single row; one is null.
    label = (
        F.when(F.col("id") == 7, "single")
        .when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 11 == 1, None)
        .otherwise(F.concat(F.lit("l"), (F.col("id") % 4).cast("string")))
    )
    return spark.range(3000).withColumn("label", label).cache()


def by_hash(log, seed):
    """Ids of each label in hash order, sorted here instead of in Spark."""
    groups = {}
    for row in log.select("id", "label", stable_hash("id", seed).alias("h")).collect():
        groups.setdefault(row["label"], []).append((row["h"], row["id"]))
    return {label: [i for _, i in sorted(rows)] for label, rows in groups.items()}


def test_fraction_is_stable_under_partitioning(log):
    one = {r.id for r in sampling.sample_fraction(log.coalesce(1), "id", 0.1, 5).collect()}
    many = {r.id for r in sampling.sample_fraction(log.repartition(13), "id", 0.1, 5).collect()}
    other = {r.id for r in sampling.sample_fraction(log, "id", 0.1, 6).collect()}
    assert one == many != other
    assert 220 < len(one) < 380


def test_train_test_cover_and_do_not_overlap(log):
    train, test = sampling.train_test(log, "id", 0.3, 42)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not a & b
    assert len(a | b) == 3000
    marked = sampling.mark_test(log, "id", 0.3, 42)
    assert {r.id for r in marked.where("is_test").collect()} == b


@pytest.mark.parametrize("k", [0, 1, 17, 2999, 3000, 5000])
def test_exact_sample(log, k):
    found = sampling.sample_exact(log, "id", k, 3)
    ids = [r.id for r in found.collect()]
    assert len(ids) == len(set(ids)) == min(k, 3000)
    order = [i for _, i in sorted(
        (r["h"], r["id"]) for r in log.select("id", stable_hash("id", 3).alias("h")).collect()
    )]
    assert set(ids) == set(order[:k])


def test_exact_sample_of_nothing(log):
    assert sampling.sample_exact(log.where("false"), "id", 5, 3).count() == 0


@pytest.mark.parametrize("narrow_rows", [1, 20, 100_000])
def test_narrowing_finds_the_same_cuts(log, narrow_rows):
    ranks = lambda n: [F.ceil(n / 3), F.ceil(n / 2)]
    cuts = sampling.cut_points(log, "id", ranks, 8, "label", narrow_rows=narrow_rows)
    order = by_hash(log, 8)
    hashes = {r.id: r.h for r in log.select("id", stable_hash("id", 8).alias("h")).collect()}
    found = {r["_label"]: (r["_cut0"]["hash"], r["_cut1"]["hash"]) for r in cuts.collect()}
    assert found == {
        label: (hashes[ids[-(-len(ids) // 3) - 1]], hashes[ids[-(-len(ids) // 2) - 1]])
        for label, ids in order.items()
    }


def test_many_labels(spark):
    df = spark.range(2000).withColumn("label", F.col("id") % 500)
    split = sampling.stratified_test(df, "id", "label", 0.25, 1)
    assert [tuple(r) for r in split.groupBy("is_test").count().orderBy("is_test").collect()] == [
        (False, 1500), (True, 500),
    ]
    assert split.where("is_test").select("label").distinct().count() == 500


def test_stratified_split(log):
    split = sampling.stratified_test(log, "id", "label", 0.1, 42)
    assert split.count() == 3000
    order = by_hash(log, 42)
    expected = {i for ids in order.values() for i in ids[: int(np.ceil(round(len(ids) * 0.1, 6)))]}
    assert {r.id for r in split.where("is_test").collect()} == expected


def test_folds_differ_by_at_most_one(log):
    folds = sampling.stratified_folds(log, "id", "label", 3, 42)
    counts = {}
    for r in folds.groupBy("label", "fold").count().collect():
        counts.setdefault(r["label"], [0, 0, 0])[r["fold"]] = r["count"]
    assert sum(map(sum, counts.values())) == 3000
    assert all(max(c) - min(c) <= 1 for c in counts.values())
    assert counts["single"] == [1, 0, 0]


def test_folds_among_some_rows(log):
    even = F.col("id") % 2 == 0
    folds = sampling.stratified_folds(log, "id", "label", 3, 42, among=even)
    alone = sampling.stratified_folds(log.where(even), "id", "label", 3, 42)
    assert folds.where("fold IS NULL").count() == 1500
    assert sorted(map(tuple, folds.where(even).collect()), key=str) == sorted(
        map(tuple, alone.collect()), key=str
    )


def test_split_does_not_shuffle_the_rows(spark, tmp_path):
    spark.range(1000).withColumn("label", F.col("id") % 2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = sampling.stratified_test(df, "id", "label", 0.1, 42)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert "Window" not in plan


def test_bad_arguments(log):
    with pytest.raises(ValueError):
        sampling.sample_exact(log, "id", -1, 1)
    with pytest.raises(ValueError):
        sampling.stratified_test(log, "id", "label", 0, 1)
    with pytest.raises(ValueError):
        sampling.stratified_folds(log, "id", "label", 1, 1)
    with pytest.raises(ValueError):
        sampling.sample_fraction(log, "id", 1.5, 1)


@pytest.fixture(scope="module")
def odd(spark):
    """900 rows: a third without a key, a third with one and the same, the rest in pairs of
    equal rows."""
    rows = [(None, i, "x") for i in range(200)] + [(None, -1, "x")] * 100
    rows += [("same", i % 5, "y") for i in range(300)]
    rows += [(f"k{i // 2}", 0, "z" if i % 4 < 2 else None) for i in range(300)]
    return spark.createDataFrame(rows, "key string, v int, label string").cache()


@pytest.mark.parametrize("k", [1, 10, 299, 450, 777, 899, 900, 2000])
@pytest.mark.parametrize("key", ["key", ["key", "v"]])
def test_exact_size_without_a_unique_key(odd, key, k):
    found = sampling.sample_exact(odd, key, k, 3)
    assert found.columns == odd.columns
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == min(k, 900)
    every = [tuple(r) for r in odd.collect()]
    assert all(rows.count(r) <= every.count(r) for r in set(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splits_leave_no_row_unmarked(odd, seed):
    split = sampling.stratified_test(odd, "key", "label", 0.3, seed)
    marks = split.groupBy("label").agg(
        F.count_if("is_test").alias("test"), F.count("*").alias("n"), F.count("is_test").alias("marked")
    )
    for r in marks.collect():
        assert r.marked == r.n and r.test == -(-r.n * 3 // 10)
    folds = sampling.stratified_folds(odd, "key", "label", 3, seed)
    sizes = folds.groupBy("label", "fold").count().collect()
    assert sum(r["count"] for r in sizes) == 900 and {r.fold for r in sizes} == {0, 1, 2}
    for label in ("x", "y", "z", None):
        of = [r["count"] for r in sizes if r.label == label]
        assert max(of) - min(of) <= 1
    marked = sampling.mark_test(odd, "key", 0.3, seed).where("key IS NULL AND v >= 0")
    assert 0 < marked.where("is_test").count() < marked.count() == 200


def test_very_small_shares(spark):
    rows = spark.range(2_000_000)
    assert 0 < sampling.sample_fraction(rows, "id", 1e-5, 1).count() < 60
    assert sampling.sample_fraction(rows, "id", 1e-9, 1).count() <= 2
    assert hashes_below(1e-9) == round(2**60 / 10**9)


def test_keys_of_several_columns_do_not_run_together(spark):
    rows = [("a", None, "b"), ("a", "b", None), ("a:b", "c", None), ("a", "b:c", None), ("", None, None), (None, "", None)]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    hashes = [r[0] for r in df.select(stable_hash(["x", "y", "z"], 1)).collect()]
    assert len(set(hashes)) == len(rows)


def test_copies_of_one_row_are_numbered_where_they_lie(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.lit("x").alias("v"))
    df = df.repartition(7).withColumns({"_hash": F.xxhash64("k"), "_tie": F.xxhash64("k", "v")})
    rows = sampling._numbered(df)
    assert rows.columns == [*df.columns, "_i"]
    hot = sorted(r._i for r in rows.where("k = -1").collect())
    assert hot == list(range(1, 3334))
    assert {r._i for r in rows.where("k >= 0").collect()} == {1}


@pytest.mark.parametrize("k", [1, 1000, 3000, 4999])
def test_exact_sample_of_copies(spark, k):
    df = spark.range(5000).select(F.lit("same").alias("k"), (F.col("id") % 2).alias("v")).repartition(5)
    kept = sampling.sample_exact(df, "k", k, 3)
    assert kept.count() == k
    both = {r.v: r["count"] for r in kept.groupBy("v").count().collect()}
    assert k < 2500 and len(both) == 1 or k > 2500 and 2500 in both.values()


@pytest.mark.parametrize("about, scans", [(3000, 1), (2500, 1), (6000, None), (100_000, None), (10, None)])
def test_exact_sample_from_one_scan(spark, log, about, scans):
    """The same rows as by counting; the rows of the source are read once if the number is right."""
    wanted = {r.id for r in sampling.sample_exact(log, "id", 200, 4).collect()}
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    source = log.where("id IS NOT NULL").mapInPandas(counted, "id bigint, label string")
    got = sampling.sample_exact(source, "id", 200, 4, about=about)
    assert {r.id for r in got.collect()} == wanted and len(wanted) == 200
    assert scans is None or seen.value == scans * 3000
