"""Who belongs to which class, as bitmaps: sets over any number of classes from one aggregate.

Every key has a number. A class is a set of numbers, kept as bitmaps of 32,768 bits each. Sets are
intersected and united by combining bitmaps, whose size depends on the keys only; the rows the
classes came from are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import ranked
from tallyloom.operators.reshape import to_long
from tallyloom.operators.small import pin

#: A class: a column and its value there.
Class = tuple[str, str]


def key_numbers(df: DataFrame, key: str) -> DataFrame:
    """``key`` and ``number`` (from 1, in the order of the keys) of every key that is not null."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return pin(ranked(keys, [F.col(key)], name="number"))


def class_bitmaps(df: DataFrame, numbers: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``column``, ``class``, ``bucket`` and ``bitmap``: the keys of each class of the columns, from one
    aggregate. A key that has several rows belongs to the classes of all of them; nulls are no
    class."""
    rows = df.select(key, *columns).join(numbers, key)
    long = to_long(rows, ["number"], columns, variable="column", value="class", as_type="string")
    bit = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return long.where("class IS NOT NULL").groupBy("column", "class", bucket).agg(bit)


def _of(bitmaps: DataFrame, classes: Sequence[Class]) -> DataFrame:
    wanted = F.lit(False)
    for column, name in classes:
        wanted = wanted | ((F.col("column") == column) & (F.col("class") == name))
    return bitmaps.where(wanted)


def in_every(bitmaps: DataFrame, classes: Sequence[Class]) -> DataFrame:
    """``bucket`` and ``bitmap`` of the keys that are in all of the (different) classes."""
    found = _of(bitmaps, classes).groupBy("bucket").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("_n")
    )
    return found.where(F.col("_n") == len(set(classes))).drop("_n")


def in_any(bitmaps: DataFrame, classes: Sequence[Class]) -> DataFrame:
    """``bucket`` and ``bitmap`` of the keys that are in at least one of the classes."""
    return _of(bitmaps, classes).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def class_sizes(bitmaps: DataFrame) -> DataFrame:
    """``column``, ``class`` and the number of its keys, ``n``."""
    return bitmaps.groupBy("column", "class").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def _has_bit(number: str) -> Column:
    position = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substr("bitmap", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def members_of(found: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """The keys of a set of bitmaps."""
    placed = numbers.withColumn("bucket", F.bitmap_bucket_number("number"))
    return placed.join(found, "bucket").where(_has_bit("number")).select(key)
