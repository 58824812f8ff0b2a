"""Stable pseudo-random numbers from a row's key.

``rand`` and ``sample`` depend on how the input is partitioned, and give other rows when a
lost task is run again. A hash of the key and a seed depends on neither.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 60


def key_names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def key_is_null(key: str | Sequence[str]) -> Column:
    """Whether no column of the key has a value."""
    found = F.lit(True)
    for name in key_names(key):
        found = found & F.col(name).isNull()
    return found


def stable_hash(key: str | Sequence[str], seed: int | str) -> Column:
    """60 uniform bits of an md5 of the key and the seed, as a non-negative bigint.

    Every part goes in with its length in front, and null as a mark of its own, so different
    keys are different texts.
    """
    parts = []
    for name in key_names(key):
        text = F.col(name).cast("string")
        size = F.octet_length(text).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), text, F.lit(";")), F.lit("-;")))
    text = F.concat(*parts, F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def row_hash(df: DataFrame, key: str | Sequence[str], seed: int) -> Column:
    """The hash of the key; rows without a key are told apart by all their columns."""
    return F.when(key_is_null(key), stable_hash(df.columns, seed)).otherwise(stable_hash(key, seed))


def hashes_below(fraction: float) -> int:
    """How many of all hashes make up ``fraction``, to the nearest one."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    return round(Fraction(str(fraction)) * 2**HASH_BITS)


def falls_in(df: DataFrame, key: str | Sequence[str], fraction: float, seed: int) -> Column:
    """True for about ``fraction`` of all keys, always the same ones for a seed."""
    return row_hash(df, key, seed) < F.lit(hashes_below(fraction))
