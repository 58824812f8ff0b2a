"""Training and evaluation of the click models, from the log to saved models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import evaluate, features, models, sampling
from tallyloom.session import ensure_checkpoint_dir
from tallyloom.sources.files import write_table

# Share of the training rows to fit on, of test rows, of validation rows; the seed.
MODEL_SHARE = 0.1
TEST_SHARE = 0.3
VALID_SHARE = 0.1
SEED = 42


@dataclass(frozen=True)
class Prepared:
    """Folded rows of one log with their parts, and the encoder fitted on its training rows.

    ``folded`` has the feature columns, ``label``, ``is_test``, ``fold``, ``is_valid`` and
    ``n``, the number of impressions a row stands for.
    """

    folded: DataFrame
    columns: tuple[str, ...]
    encoder: PipelineModel

    def rows(self, condition: str, *parts: str) -> DataFrame:
        """Encoded rows of some parts. Rows that differ only in parts not asked for are one."""
        merged = (
            self.folded.where(condition)
            .groupBy(*self.columns, "label", *parts)
            .agg(F.sum("n").alias("n"))
        )
        encoded = self.encoder.transform(merged)
        return encoded.select(*merged.columns, "features")

    @property
    def names(self) -> list[str]:
        """Names of the encoded features."""
        return features.feature_names(self.encoder.transform(self.folded))

    @cached_property
    def train(self) -> DataFrame:
        """Training rows with their weights."""
        return features.with_class_weights(self.rows("NOT is_test"))

    @cached_property
    def train_in_folds(self) -> DataFrame:
        return features.with_class_weights(self.rows("NOT is_test", "fold"))

    @property
    def test(self) -> DataFrame:
        """Test rows, not encoded: the models do that themselves."""
        return self.folded.where("is_test").select(*self.columns, "label", "n")


def prepare(
    log: DataFrame,
    key: str = "id",
    columns: Sequence[str] = features.MODEL_FEATURES,
    encoded: Sequence[str] = features.ENCODED,
    target: str = features.TARGET,
    share: float = 1.0,
    seed: int = SEED,
    slots: int | None = None,
) -> Prepared:
    """Split, fold and encode a log. ``share`` bounds the rows fitted on, never the test rows.
    With ``slots`` encoded columns are hashed into so many slots each, however many values they
    have; without it every value has a slot, and all of them pass through the driver.

    Impressions without a label belong to no part.

    Parts are set per impression from its key; then equal rows are folded. The folded table
    is read by every iteration of every fit, so it goes to the checkpoint folder: a lost
    executor costs reading it again, not another pass over the log.
    """
    rows = features.model_frame(log, columns, target, key).where("label IS NOT NULL")
    rows = sampling.mark_test(rows, key, TEST_SHARE, seed + 1)
    if share < 1:
        rows = rows.where(F.col("is_test") | sampling.falls_in(rows, key, share, seed))
    training = ~F.col("is_test")
    # Fold ends and the end of the validation rows are ranks in one order, found together.
    ends = [f"end{j}" for j in range(1, models.FOLDS)]
    ranks = lambda n: [
        *sampling.fold_ranks(n, models.FOLDS),
        sampling.share_rank(n, VALID_SHARE),
    ]
    rows = sampling.mark_after(
        rows, key, ranks, seed + 2, [*ends, "for_training"], "label", training
    ).withColumns({"fold": sampling.fold_number(ends), "is_valid": ~F.col("for_training")})
    parts = ["is_test", "fold", "is_valid"]
    folded = features.fold_equal_rows(rows, *columns, "label", *parts)
    ensure_checkpoint_dir(log.sparkSession)
    folded = folded.checkpoint()
    if slots is None:
        stages = features.encoder(columns, encoded)
    else:
        stages = features.hashing_encoder(columns, encoded, slots)
    encoder = stages.fit(folded.where("NOT is_test"))
    return Prepared(folded, tuple(columns), encoder)


@dataclass(frozen=True)
class Trained:
    path: list[models.PathPoint]
    c: float
    logistic: PipelineModel
    selected: list[str]
    boosted: PipelineModel
    scored: DataFrame


def logistic(prepared: Prepared, c: float, l1: float = 1.0) -> PipelineModel:
    """Encoder and logistic regression as one model."""
    fitted = models.fit_logistic(prepared.train, c, l1)
    return PipelineModel([*prepared.encoder.stages, fitted])


def boosted(prepared: Prepared, keep: Sequence[int], **settings) -> PipelineModel:
    """Encoder, selection and boosted trees as one model."""
    select = features.slicer(keep)
    train = select.transform(prepared.rows("NOT is_test AND NOT is_valid"))
    valid = select.transform(prepared.rows("NOT is_test AND is_valid"))
    fitted = models.fit_boosted(train, valid, **settings)
    return PipelineModel([*prepared.encoder.stages, select, fitted])


def forest(prepared: Prepared, **settings) -> PipelineModel:
    """Encoder and random forest as one model."""
    fitted = models.fit_forest(prepared.rows("NOT is_test"), **settings)
    return PipelineModel([*prepared.encoder.stages, fitted])


def train(
    log: DataFrame, key: str = "id", share: float = MODEL_SHARE, slots: int | None = None, **settings
) -> Trained:
    """Penalty path, feature selection, boosted trees, scored test rows."""
    prepared = prepare(log, key, share=share, slots=slots)
    path = models.penalty_path(prepared.train_in_folds)
    c = models.choose_penalty(path)
    first = logistic(prepared, c)
    keep = features.kept_slots(first.stages[-1].coefficients)
    if not keep:
        raise ValueError(f"no feature is left at penalty {c}")
    names = prepared.names
    second = boosted(prepared, keep, **settings)
    scored = models.predictions(second, prepared.test, "label", "n")
    # The metrics need no more than the rows per label and score.
    scored = scored.groupBy("label", "score", "prediction").agg(F.sum("n").alias("n"))
    return Trained(path, c, first, [names[i] for i in keep], second, scored.checkpoint())


def metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, both areas under the curve, weighted F1 and log-loss, in one row."""
    single = evaluate.accuracy(scored, weight="n")
    return single.select(
        "accuracy",
        evaluate.roc_auc(scored, weight="n").scalar().alias("auc_score"),
        evaluate.roc_auc_hard(scored, weight="n").scalar().alias("auc_hard"),
        evaluate.weighted_f1(scored, weight="n").scalar().alias("weighted_f1"),
        evaluate.log_loss(scored, weight="n").scalar().alias("log_loss"),
    )


def path_table(spark: SparkSession, path: Sequence[models.PathPoint], chosen: float) -> DataFrame:
    """The penalty path as a table, one row per penalty."""
    rows = [(p.c, p.weighted_f1, p.kept, p.c == chosen) for p in path]
    return spark.createDataFrame(rows, "c double, weighted_f1 double, kept double, chosen boolean")


def save(result: Trained, folder: str) -> None:
    """Write both models and the tables of the two model charts."""
    result.logistic.write().overwrite().save(f"{folder}/logistic")
    result.boosted.write().overwrite().save(f"{folder}/boosted")
    spark = result.scored.sparkSession
    write_table(path_table(spark, result.path, result.c), f"{folder}/f1_path")
    write_table(
        evaluate.classification_report(result.scored, weight="n"), f"{folder}/classification"
    )
    write_table(metrics(result.scored), f"{folder}/metrics")
