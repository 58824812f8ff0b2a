"""From impressions to model input: projection, one-hot encoding, weights, selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.small import levels, pin

# The model's inputs, and those of them that are encoded.
MODEL_FEATURES = (
    "weekday",
    "hour_in_day",
    "banner_pos",
    "site_category",
    "device_conn_type",
    "app_category",
    "device_type",
)
ENCODED = ("site_category", "app_category", "banner_pos")
TARGET = "click"

# A coefficient below this size counts as zero (the usual threshold for an L1 penalty).
ZERO_COEFFICIENT = 1e-5


def model_frame(
    df: DataFrame, features: Sequence[str] = MODEL_FEATURES, target: str = TARGET, *ids: str
) -> DataFrame:
    """Id, feature and label columns, the label as 0/1."""
    return df.select(*ids, *features, F.col(target).cast("int").alias("label"))


def one_hot(
    df: DataFrame, columns: Sequence[str], values: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Replace each column by one 0/1 column per value, named ``column_value``.

    A null row is 0 everywhere. Without ``values`` the values found in the data are used.
    For many values use :func:`encoder`, which keeps the row a sparse vector.
    """
    given = dict(values or {})
    missing = [c for c in columns if c not in given]
    found = given | (levels(df, missing) if missing else {})
    kinds = dict(df.dtypes)
    hot = [
        F.coalesce((F.col(c) == F.lit(v).cast(kinds[c])).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in columns
        for v in found[c]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *hot)


def encoder(
    features: Sequence[str] = MODEL_FEATURES, encoded: Sequence[str] = ENCODED
) -> Pipeline:
    """Pipeline to a sparse ``features`` vector: numeric columns first, then one slot per
    value of each encoded column, in alphabetical order.

    The indexer keeps a place for values it has not seen; it comes last and the encoder
    drops it, so an unseen or null value is 0 in every slot.
    """
    indexed = [f"{c}_index" for c in encoded]
    hot = [f"{c}_hot" for c in encoded]
    numeric = [c for c in features if c not in encoded]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=list(encoded),
                outputCols=indexed,
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
            VectorAssembler(inputCols=numeric + hot, outputCol="features"),
        ]
    )


#: Bits of a value's hash that choose its slot.
SLOT_BITS = 60


def _slot_sql(column: str, slots: int) -> str:
    """SQL of the slot of a value: bits of an md5 of its text, the same for every run and table."""
    text = f"md5(concat('{column}=', CAST(`{column}` AS STRING)))"
    return f"CAST(conv(substring({text}, 1, {SLOT_BITS // 4}), 16, 10) AS BIGINT) % {slots}"


def hashed_slots(df: DataFrame, columns: Sequence[str], slots: int, *ids: str) -> DataFrame:
    """``column`` and ``slot`` of the value of each column, one row per input row and column; a null
    has none."""
    if slots < 1:
        raise ValueError("at least one slot is needed")
    entries = [
        F.struct(F.lit(c).alias("column"), F.expr(_slot_sql(c, slots)).alias("slot")) for c in columns
    ]
    return df.select(*ids, F.inline(F.array(*entries))).where("slot IS NOT NULL")


def hash_collisions(df: DataFrame, columns: Sequence[str], slots: int) -> DataFrame:
    """What hashing costs, per column: different ``values``, ``slots`` in use, values and rows that
    share a slot with another value (``shared_values``, ``shared_rows``). Columns without a value
    have no row. Values are counted where they are shuffled to, none goes through the driver."""
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.expr(_slot_sql(c, slots)).alias("slot")
        )
        for c in columns
    ]
    long = df.select(F.inline(F.array(*entries))).where("value IS NOT NULL")
    values = long.groupBy("column", "slot", "value").agg(F.count(F.lit(1)).alias("n"))
    by_slot = values.groupBy("column", "slot").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))
    shared = F.col("values") > 1
    return by_slot.groupBy("column").agg(
        F.sum("values").alias("values"),
        F.count(F.lit(1)).alias("slots"),
        F.coalesce(F.sum(F.when(shared, F.col("values"))), F.lit(0)).alias("shared_values"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("shared_rows"),
    )


def hashing_encoder(
    features: Sequence[str] = MODEL_FEATURES,
    encoded: Sequence[str] = ENCODED,
    slots: int = 1024,
) -> Pipeline:
    """Like :func:`encoder`, but each encoded column has a fixed number of slots, and the hash of a
    value chooses its own.

    For columns of any number of values: fitting reads nothing, no value reaches the driver, and
    the vector has the same length for every log. A value that was not seen before has a slot as
    well; a null is 0 in every slot. Values that share a slot count as one:
    :func:`hash_collisions` tells how many do.
    """
    if slots < 2:
        raise ValueError("at least two slots are needed")
    named = [f"{c}_slot" for c in encoded]
    indexed = [f"{c}_index" for c in encoded]
    hot = [f"{c}_hot" for c in encoded]
    added = ", ".join(f"CAST({_slot_sql(c, slots)} AS STRING) AS `{n}`" for c, n in zip(encoded, named))
    numbers = [str(i) for i in range(slots)]
    indexer = StringIndexerModel.from_arrays_of_labels(
        [numbers] * len(named), inputCols=named, outputCols=indexed, handleInvalid="keep"
    )
    numeric = [c for c in features if c not in encoded]
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__"),
            indexer,
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
            VectorAssembler(inputCols=numeric + hot, outputCol="features"),
        ]
    )


def long_features(
    df: DataFrame,
    fitted: PipelineModel,
    *ids: str,
    features: Sequence[str] = MODEL_FEATURES,
    encoded: Sequence[str] = ENCODED,
) -> DataFrame:
    """What the fitted encoder's vectors hold, one row per input row and non-zero slot.

    Made from the columns themselves: a number is its own slot, an encoded value the slot of
    that value if the encoder knows it. No vector is unfolded, so the work does not grow with
    the number of slots.
    """
    labels = dict(zip(encoded, fitted.stages[0].labelsArray))
    known = df.sparkSession.createDataFrame(
        [(c, v) for c, vs in labels.items() for v in vs], "_column string, _text string"
    )
    numbers = [
        F.struct(F.lit(c).alias("_column"), F.lit(None).cast("string").alias("_text"),
                 F.col(c).cast("double").alias("value"))
        for c in features if c not in encoded
    ]
    texts = [
        F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_text"), F.lit(1.0).alias("value"))
        for c in encoded
    ]
    long = df.select(*ids, F.inline(F.array(*numbers, *texts))).where("value <> 0")
    slots = known.withColumn("feature", F.concat_ws("_", "_column", "_text"))
    joined = long.join(slots, ["_column", "_text"], "left")
    is_number = ~F.col("_column").isin(*encoded)
    name = F.when(is_number, F.col("_column")).otherwise(F.col("feature"))
    return joined.select(*ids, name.alias("feature"), "value").where("feature IS NOT NULL")


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the slots of a feature vector, from its metadata."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"].values()
    slots = sorted((a["idx"], a["name"]) for group in groups for a in group)
    return [name.replace("_hot_", "_", 1) for _, name in slots]


def fold_equal_rows(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Fold equal rows into one with their number.

    The click model has few distinct inputs, so this shrinks the training data to a size
    that no longer grows with the log, and a fit weighted by ``n`` has the same optimum.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def class_weights(df: DataFrame, label: str = "label", weight: str | None = None) -> DataFrame:
    """Rows per label and the weight that balances them: all rows / (labels * rows)."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.where(F.col(label).isNotNull()).groupBy(label).agg(rows.alias("n"))
    totals = counted.agg(F.struct(F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels")))
    whole = totals.scalar()
    return counted.withColumn("weight", whole["all"] / (whole["labels"] * F.col("n")))


def with_class_weights(df: DataFrame, label: str = "label", rows: str = "n") -> DataFrame:
    """Add ``weight``: the row's multiplicity times the balanced weight of its label."""
    table = pin(class_weights(df, label, rows).select(label, F.col("weight").alias("_balance")))
    # Rows without a label have no weight and take no part in a fit.
    return df.join(table, label).withColumn("weight", F.col(rows) * F.col("_balance")).drop("_balance")


def kept_slots(coefficients: Sequence[float]) -> list[int]:
    """Indices of the features an L1 fit has kept."""
    return [i for i, c in enumerate(coefficients) if abs(c) >= ZERO_COEFFICIENT]


def slicer(indices: Sequence[int]) -> VectorSlicer:
    """Stage that keeps only the given slots, as ``selected``."""
    return VectorSlicer(inputCol="features", outputCol="selected", indices=list(indices))
