import pytest
from pyspark.sql import functions as F

from tallyloom.operators import features


@pytest.fixture
def frame(spark):
    rows = [("a", 0, 3, 1), ("b", 1, 4, 0), (None, 1, 5, 0), ("a", None, 6, 0)]
    return spark.createDataFrame(rows, "site string, banner int, hour int, label int")


def test_one_hot_table(frame):
    hot = features.one_hot(frame, ["site", "banner"])
    assert hot.columns == ["hour", "label", "site_a", "site_b", "banner_0", "banner_1"]
    assert {tuple(r) for r in hot.collect()} == {
        (3, 1, 1, 0, 1, 0), (4, 0, 0, 1, 0, 1), (5, 0, 0, 0, 0, 1), (6, 0, 1, 0, 0, 0),
    }


def test_one_hot_with_given_values(frame):
    assert features.one_hot(frame, ["site"], {"site": ["a", "z"]}).columns[-2:] == ["site_a", "site_z"]


def test_encoder_equals_the_table(frame):
    model = features.encoder(["hour", "site", "banner"], ["site", "banner"]).fit(frame)
    encoded = model.transform(frame)
    assert features.feature_names(encoded) == ["hour", "site_a", "site_b", "banner_0", "banner_1"]
    hot = features.one_hot(frame, ["site", "banner"]).drop("label")
    assert {tuple(r[0].toArray()) for r in encoded.select("features").collect()} == {
        tuple(float(v) for v in r) for r in hot.collect()
    }


def test_unseen_value_is_zero_everywhere(spark, frame):
    model = features.encoder(["hour", "site"], ["site"]).fit(frame)
    other = spark.createDataFrame([("new", 9)], "site string, hour int")
    assert list(model.transform(other).first()["features"].toArray()) == [9.0, 0.0, 0.0]


def test_selection_keeps_names(frame):
    encoded = features.encoder(["hour", "site"], ["site"]).fit(frame).transform(frame)
    kept = features.kept_slots([0.0, -2e-5, 9e-6])
    assert kept == [1]
    selected = features.slicer(kept).transform(encoded)
    assert selected.first()["selected"].size == 1


def test_class_weights(frame):
    found = {r["label"]: (r["n"], r["weight"]) for r in features.class_weights(frame).collect()}
    assert found == {0: (3, pytest.approx(4 / 6)), 1: (1, 2.0)}


def test_class_weights_balance(frame):
    weighted = features.with_class_weights(frame.withColumn("n", F.lit(2)))
    sums = {r[0]: r[1] for r in weighted.groupBy("label").agg(F.sum("weight")).collect()}
    assert sums[0] == pytest.approx(sums[1]) == pytest.approx(4.0)


def test_single_label(frame):
    only = features.class_weights(frame.where("label = 0")).collect()
    assert [tuple(r) for r in only] == [(0, 3, 1.0)]


def test_folding_keeps_the_number_of_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "a int, b string")
    assert {tuple(r) for r in features.fold_equal_rows(df, "a", "b").collect()} == {(1, "x", 2), (2, "x", 1)}


def test_model_frame(spark):
    df = spark.createDataFrame([(1, 5, True, "no")], "id int, f int, click boolean, other string")
    out = features.model_frame(df, ["f"], "click", "id")
    assert out.dtypes == [("id", "int"), ("f", "int"), ("label", "int")]


def test_hashing_needs_no_pass_over_the_values(spark, frame):
    """Fitting reads nothing: it succeeds on a frame whose rows cannot be computed."""
    failing = frame.withColumn("site", F.when(F.lit(True), F.raise_error(F.lit("read"))).cast("string"))
    model = features.hashing_encoder(["hour", "site", "banner"], ["site", "banner"], 8).fit(failing)
    encoded = model.transform(frame)
    names = features.feature_names(encoded)
    assert names == ["hour", *[f"{c}_{i}" for c in ("site", "banner") for i in range(8)]]
    slots = {(r.hour, r.column): r.slot for r in features.hashed_slots(frame, ["site", "banner"], 8, "hour").collect()}
    assert len(slots) == 6 and all(0 <= s < 8 for s in slots.values())
    for r in encoded.select("hour", "features").collect():
        wanted = {"hour": float(r.hour)}
        wanted |= {f"{c}_{slots[r.hour, c]}": 1.0 for c in ("site", "banner") if (r.hour, c) in slots}
        assert dict(zip((names[i] for i in r.features.indices), r.features.values)) == wanted


def test_hashing_an_unseen_value_and_many_values(spark):
    wide = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("site"), F.lit(1).alias("hour"))
    model = features.hashing_encoder(["hour", "site"], ["site"], 64).fit(wide.limit(1))
    vectors = [r[0] for r in model.transform(wide).select("features").collect()]
    assert {v.size for v in vectors} == {65} and {len(v.indices) for v in vectors} == {2}
    with pytest.raises(ValueError):
        features.hashing_encoder(slots=1)


def test_collisions(spark):
    rows = [("x", i % 50) for i in range(500)] + [(None, 3)]
    df = spark.createDataFrame(rows, "site string, code int")
    slots = {r.slot for r in features.hashed_slots(df, ["code"], 16).distinct().collect()}
    found = {r.column: r for r in features.hash_collisions(df, ["site", "code"], 16).collect()}
    assert tuple(found["site"])[1:] == (1, 1, 0, 0)
    by_slot = {}
    for r in features.hashed_slots(df, ["code"], 16, "code").distinct().collect():
        by_slot.setdefault(r.slot, set()).add(r.code)
    shared = [v for s in by_slot.values() if len(s) > 1 for v in s]
    in_shared = sum(10 + (v == 3) for v in shared)
    assert tuple(found["code"])[1:] == (50, len(slots), len(shared), in_shared)
    assert features.hash_collisions(df.where("false"), ["site"], 4).count() == 0
    assert {r.column: r.shared_values for r in features.hash_collisions(df, ["code"], 2**40).collect()} == {"code": 0}
