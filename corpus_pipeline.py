"""The corpus pipeline: from raw documents to a mix for training.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of ``docs``; the last adds ``epoch`` and ``taken``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import leaks, lines, mixing, quality, simhash
from tallyloom.llm.shared import documents, written
from tallyloom.sources.tables import table

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def _with_text_of(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order; ``n_chars`` follows the text if there is one."""
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.char_length("text").cast(kind))
    return done.select(docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that holds them; a document may end up empty."""
    return _with_text_of(docs, lines.drop_repeated_lines(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id; texts without a
    word are one group with those near them, repeated rows one row."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken into the mix."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_copies", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, applied to ``documents``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
