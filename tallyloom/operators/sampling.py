"""Samples, splits and folds that come out the same on every run.

Rows are put in the order of a hash of their key, one column or several. A share of the rows
is a comparison with that hash. An exact number of rows needs the hash of the k-th row;
:func:`cut_points` finds it by counting, and the rows themselves are then told apart by
comparing with it, so the table is filtered where it lies and never shuffled or sorted.

Keys need not be unique. Rows without a key have a place of their own by the hash of all
their columns. Rows with equal keys are in the order of a second hash, of all columns; rows
that are equal throughout are counted, and as many of them as needed fall on either side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import HASH_BITS, falls_in, key_is_null, row_hash, stable_hash
from tallyloom.operators.small import pin

# Turns the number of rows into the last rank of each part but the last.
Ranks = Callable[[Column], list[Column]]
Key = str | Sequence[str]

PREFIX_BITS = 12
NARROW_ROWS = 100_000


def sample_fraction(df: DataFrame, key: Key, fraction: float, seed: int) -> DataFrame:
    """About ``fraction`` of the rows, without replacement."""
    return df.where(falls_in(df, key, fraction, seed))


def mark_test(
    df: DataFrame, key: Key, fraction: float, seed: int, name: str = "is_test"
) -> DataFrame:
    """Mark about ``fraction`` of the rows as test rows."""
    return df.withColumn(name, falls_in(df, key, fraction, seed))


def train_test(
    df: DataFrame, key: Key, fraction: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: disjoint, and together all rows."""
    test = falls_in(df, key, fraction, seed)
    return df.where(~test), df.where(test)


def sample_exact(df: DataFrame, key: Key, k: int, seed: int, about: int | None = None) -> DataFrame:
    """Exactly ``k`` rows (all if there are fewer), whatever the key.

    Given ``about`` how many rows there are (from a file's footer, its size, or an earlier run), the
    table is read once: rows whose hash could be among the first ``k`` are kept as they pass, and
    the cut is made among those. Nothing is held in a task. If they turn out too few, as there are
    fewer rows than said, the table is read again; the rows are the same in any case.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    if k == 0:
        return df.limit(0)
    if about is not None:
        first = _first_rows(df, key, k, seed, about)
        if first is not None:
            return first
    marked = mark_after(df, key, lambda n: [F.least(F.lit(k), n)], seed, ["_after"])
    return marked.where("NOT _after").drop("_after")


#: Standard deviations of a count that a single pass allows for.
SPARE = 6


def _first_rows(df: DataFrame, key: Key, k: int, seed: int, about: int) -> DataFrame | None:
    """The first ``k`` rows from one pass; None if fewer passed the limit."""
    if about <= k:
        return None
    limit = min(1.0, (k + SPARE * math.sqrt(k) + SPARE) / about)
    near = pin(df.where(row_hash(df, key, seed) < F.lit(int(limit * 2**HASH_BITS))))
    if near.count() < k:
        return None
    return sample_exact(near, key, k, seed)


def stratified_test(
    df: DataFrame,
    key: Key,
    label: str,
    fraction: float,
    seed: int,
    name: str = "is_test",
    among: Column | None = None,
) -> DataFrame:
    """Mark ``ceil(fraction * n)`` rows of every label as test rows.

    With ``among`` only rows for which it holds are counted and split; the mark of all
    others is null.
    """
    marked = mark_after(
        df, key, lambda n: [share_rank(n, fraction)], seed, ["_after"], label, among
    )
    return marked.withColumn(name, ~F.col("_after")).drop("_after")


def share_rank(n: Column, fraction: float) -> Column:
    """``ceil(fraction * n)``, in exact arithmetic."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    return F.ceil(F.lit(Decimal(str(fraction))) * n)


def stratified_folds(
    df: DataFrame,
    key: Key,
    label: str,
    folds: int,
    seed: int,
    name: str = "fold",
    among: Column | None = None,
) -> DataFrame:
    """Give every row a fold; within a label the fold sizes differ by at most one.

    With ``among`` only rows for which it holds are counted and get a fold.
    """
    ends = [f"_end{j}" for j in range(1, folds)]
    marked = mark_after(df, key, lambda n: fold_ranks(n, folds), seed, ends, label, among)
    return marked.withColumn(name, fold_number(ends)).drop(*ends)


def fold_ranks(n: Column, folds: int) -> list[Column]:
    """Last ranks of all folds but the last; the first ``n % folds`` folds have a row more."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    extra = n % folds
    size = (n - extra) / folds
    return [size * j + F.least(F.lit(j), extra) for j in range(1, folds)]


def fold_number(ends: Sequence[str]) -> Column:
    """The fold of a row marked with whether it lies after the end of each fold."""
    return sum((F.col(end).cast("int") for end in ends), F.lit(0))


def mark_after(
    df: DataFrame,
    key: Key,
    ranks: Ranks,
    seed: int,
    marks: Sequence[str],
    label: str | None = None,
    among: Column | None = None,
) -> DataFrame:
    """Mark, for each rank, whether a row comes after the row of that rank.

    Ranks count within the label. With ``among`` only rows for which it holds are counted;
    the marks of all others are null.
    """
    counted = df if among is None else df.where(among)
    cuts = cut_points(counted, key, ranks, seed, label)
    names = [c for c in cuts.columns if c != "_label"]
    first, second = _order(df, key, seed)
    # The second hash reads every column; only equal keys at a cut need it.
    crowded = cuts.where(" OR ".join(f"{c}.same > 1" for c in names)).limit(1).count() > 0
    hashed = df.withColumn("_hash", first)
    if label is None:
        whole = cuts.select(F.struct(*names)).scalar()
        joined = hashed.withColumns({c: whole[c] for c in names})
    else:
        joined = hashed.join(cuts, hashed[label].eqNullSafe(cuts["_label"]), "left")
    applies = F.lit(True) if among is None else among
    if not crowded:
        after = {m: F.when(applies, F.col("_hash") > F.col(c)["hash"]) for m, c in zip(marks, names)}
        return joined.withColumns(after).select(*df.columns, *marks)
    joined = joined.withColumn("_tie", second)
    # Rows equal to the last one before a cut are as good as each other: they are counted,
    # and their copies numbered.
    equal = F.lit(False)
    for c in names:
        cut = F.col(c)
        equal = equal | ((cut["copies"] > 1) & (F.col("_hash") == cut["hash"]) & (F.col("_tie") == cut["tie"]))
    equal = F.coalesce(equal & applies, F.lit(False))
    rows = joined.where(~equal).withColumn("_i", F.lit(1).cast("bigint")).unionByName(_numbered(joined.where(equal)))
    after = {m: F.when(applies, _beyond(F.col(c))) for m, c in zip(marks, names)}
    return rows.withColumns(after).select(*df.columns, *marks)


def _numbered(copies: DataFrame) -> DataFrame:
    """Rows with ``_i``, which numbers those of one ``_hash`` and ``_tie`` from 1.

    They are numbered part by part, as they lie, and shifted by the sizes of the parts before: a row
    with very many copies is spread over as many tasks as it came from.
    """
    same, part = ["_hash", "_tie"], "_part"
    placed = {part: F.spark_partition_id(), "_place": F.monotonically_increasing_id()}
    held = pin(copies.withColumns(placed))
    earlier = Window.partitionBy(*same).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy(*same, part).agg(F.count(F.lit(1)).alias("_n")).select(
        *same, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(*same, part).orderBy("_place"))
    numbered = held.withColumn("_i", inside).join(before, [*same, part])
    return numbered.withColumn("_i", F.col("_i") + F.col("_before")).select(*copies.columns, "_i")


def _order(df: DataFrame, key: Key, seed: int) -> tuple[Column, Column]:
    """The two hashes rows are ordered by. That of all columns stands in for a missing key."""
    any_without = df.where(key_is_null(key)).limit(1).count() > 0
    first = row_hash(df, key, seed) if any_without else stable_hash(key, seed)
    return first, stable_hash(df.columns, f"{seed}/tie")


def _beyond(cut: Column) -> Column:
    """Whether copy ``_i`` of a row comes after a cut."""
    here, tie = F.col("_hash"), F.col("_tie")
    beyond = (here == cut["hash"]) & (
        (tie > cut["tie"]) | ((tie == cut["tie"]) & (cut["start"] + F.col("_i") > cut["rank"]))
    )
    return (here > cut["hash"]) | ((cut["same"] > 1) & beyond)


def cut_points(
    df: DataFrame,
    key: Key,
    ranks: Ranks,
    seed: int,
    label: str | None = None,
    narrow_rows: int = NARROW_ROWS,
) -> DataFrame:
    """The place of the rows at the given ranks: a row per label, a column per rank.

    A place has the first ``hash``, the number of rows with it (``same``), and, where that is
    over 1, the second hash (``tie``), the rows with both (``copies``), those before them
    (``start``) and the ``rank``.

    Counting by the leading bits of the hash tells which prefix a rank falls into; counting
    again inside that prefix narrows it by 12 more bits, until a prefix holds at most
    ``narrow_rows`` rows. Each pass reads the key and label columns only and sends at most
    4096 counts per label and task. Only where rows share a hash at a cut, those rows are read
    once more, whole, and cut by the second hash in the same way.
    """
    group = F.lit(0) if label is None else F.col(label)
    first, second = _order(df, key, seed)
    base = df.select(group.alias("_label"), first.alias("hash"))
    wanted = [rank.cast("bigint") for rank in ranks(F.col("rows"))]
    rows = base.groupBy("_label").agg(F.count(F.lit(1)).alias("rows"))
    asked = rows.select("_label", F.posexplode(F.array(*wanted)).alias("cut", "rank"))
    asked = pin(asked.where("rank > 0").withColumn("before", F.lit(0).cast("bigint")))
    found = _cut(base, asked, "hash", narrow_rows)
    places = found.withColumnRenamed("n", "same")
    crowd = places.where("same > 1")
    if crowd.limit(1).count():
        inside = df.select(group.alias("_label"), first.alias("hash"), second.alias("tie"))
        hot = crowd.select("_label", "cut", "rank", "before", F.col("hash").alias("_hot"))
        same = inside["_label"].eqNullSafe(hot["_label"]) & (inside["hash"] == hot["_hot"])
        # One table per cut: a label's cuts may fall into the same equal keys.
        ties = inside.join(
            hot.select(F.struct("_label", "cut").alias("_at"), F.col("_label"), "_hot"), same
        )
        ties = ties.select(F.col("_at").alias("_label"), "tie")
        asked = hot.select(F.struct("_label", "cut").alias("_label"), "cut", "rank", "before")
        split = _cut(ties, asked, "tie", narrow_rows).select(
            F.col("_label").alias("_at"), "tie", F.col("n").alias("copies"), F.col("before").alias("start")
        )
        here = F.struct("_label", "cut")
        places = places.withColumn("_at", here).join(split, "_at", "left").drop("_at")
    else:
        none = F.lit(None).cast("bigint")
        places = places.withColumns({"tie": none, "copies": none, "start": none})
    at = F.struct("hash", "same", "tie", "copies", "start", "rank")
    cuts = places.groupBy("_label").agg(
        *[F.max(F.when(F.col("cut") == j, at)).alias(f"_cut{j}") for j in range(len(wanted))]
    )
    return pin(cuts)


def _cut(base: DataFrame, asked: DataFrame, by: str, narrow_rows: int) -> DataFrame:
    """For each asked rank of a label the value of ``by`` it falls on, with the number of rows
    that have it (``n``) and of rows before those (``before``)."""
    bits = PREFIX_BITS
    spots = pin(_narrow(base, asked.withColumn("prefix", F.lit(0).cast("bigint")), by, bits))
    while bits < HASH_BITS and (spots.agg(F.max("n")).first()[0] or 0) > narrow_rows:
        bits = min(bits + PREFIX_BITS, HASH_BITS)
        spots = pin(_narrow(base, spots, by, bits))
    # Equal values are counted first, so that a hot one is a single row in the window.
    values = (
        _inside(base, spots, by, bits)
        .groupBy("_label", "cut", "rank", "before", by)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("_label", "cut").orderBy(by).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        values.withColumn("before", F.col("before") + F.sum("n").over(upto) - F.col("n"))
        .where("before < rank AND rank <= before + n")
    )


def _prefix(column: str, bits: int) -> Column:
    # Bits 0: all rows have the empty prefix.
    return F.shiftright(F.col(column), HASH_BITS - bits) if bits else F.lit(0).cast("bigint")


def _inside(base: DataFrame, spots: DataFrame, by: str, bits: int) -> DataFrame:
    """Rows that share label and prefix with a wanted rank."""
    wanted = spots.select(F.col("_label").alias("_want"), "cut", "rank", "before", "prefix")
    same = base["_label"].eqNullSafe(wanted["_want"])
    same = same & (_prefix(by, bits) == wanted["prefix"])
    return base.join(wanted, same).drop("_want", "prefix")


def _narrow(base: DataFrame, spots: DataFrame, by: str, bits: int) -> DataFrame:
    """Replace each spot by the longer prefix its rank falls into."""
    counted = (
        _inside(base, spots, by, bits - PREFIX_BITS)
        .groupBy("_label", "cut", "rank", "before", _prefix(by, bits).alias("longer"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("_label", "cut").orderBy("longer").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        counted.withColumn("before", F.col("before") + F.sum("n").over(upto) - F.col("n"))
        .where("before < rank AND rank <= before + n")
        .select("_label", F.col("longer").alias("prefix"), "n", "before", "cut", "rank")
    )
