"""What several operators use: row identity, text expressions, tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import scratch_folder
from tallyloom.sources.commits import remove
from tallyloom.sources.tables import table

# White space is the ASCII set \x20 \x09-\x0D; only A-Z are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A missing id stands for one id greater than all others.
NO_ID = 2**63 - 1


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def whole_text(text: str = "text") -> Column:
    """The text; null is the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def known_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))


def text_hash(text: str = "text") -> Column:
    """64 bits of the text. With the id it names a row: equal pairs are repeated rows."""
    return F.xxhash64(F.col(text))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; texts of ASCII bytes take the built-in fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The words of a text, an empty array if there is none."""
    stripped = F.btrim(text, F.lit(SPACES))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, r"[\x20\x09-\x0D]+")
    )


def id_remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(name).cast("string")) % modulus


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame, stored as a table in the shared folder (lineage ends there), and the table's path."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """The frame, stored as a table in the shared folder.

    The table stays until the folder named in ``spark.checkpoint.dir`` is emptied, as the
    returned frame is read lazily. What a loop replaces is stored by :func:`stored` and removed by
    :func:`removed`.
    """
    return stored(df)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no frame in use is read from."""
    remove(spark, path)
