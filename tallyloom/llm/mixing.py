"""Mixing sources to target weights: every source gives an exact budget of words."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.manifest import in_order
from tallyloom.llm.shared import WORD, known_id, text_hash, whole_text, written

# Weights by rank of the source, repeating; the mix is 1.5 times all words; no
# source is used more than twice.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Rows that one range of a source's random order should hold, and copies of a row that are
#: unfolded together.
RANGE_ROWS = 4096
COPIES = 4096
ID, TEXT_HASH, ORIGIN, KEY, RANGE = ("_mix_" + x for x in ("id", "th", "src", "key", "range"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """Target words per source, from one row per source (``ORIGIN``, ``source_size``).

    ``share`` times all words is dealt by weight; a target stops at ``repeats`` times its
    source, and what is over goes to the others by weight until none is above. The fixed
    point is found at once: with sources in the order of limit / weight, those are full up
    to which the limits plus the rest at that ratio fit into the total. The windows have no
    partition: they see one row per source.
    """
    by_name, everything = Window.orderBy(ORIGIN), Window.partitionBy(F.lit(0))
    rank = F.row_number().over(by_name) - 1
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), rank % len(weights))
    ranked = sizes.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * repeats)
    filling = (
        Window.orderBy(F.col("_limit") / F.col("_w"), ORIGIN)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    filled = ranked.withColumns(
        {
            "_total": total,
            "_limits": F.sum("_limit").over(filling),
            "_rest": F.sum("_w").over(everything) - F.sum("_w").over(filling),
        }
    ).withColumn(
        "_full",
        F.col("_limits") * F.col("_w") + F.col("_limit") * F.col("_rest")
        <= F.col("_total") * F.col("_w"),
    )
    spare = F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0)).over(
        everything
    )
    open_weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(everything)
    target = F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(
        F.try_divide(spare * F.col("_w"), open_weight.cast("double"))
    )
    return filled.select(ORIGIN, "source_size", target.alias("target"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with what names a row's source, id and text."""
    origin = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    return docs.withColumns({ORIGIN: origin, ID: known_id(), TEXT_HASH: text_hash()})


def _amounts(docs: DataFrame, weights: Sequence[int], share: float, repeats: int, seed: int) -> DataFrame:
    """A row per source, id and text: ``n`` rows of ``docs`` with ``size``; each of them is taken for
    ``base`` words, ``full`` of them for a whole text more, and one after those for ``partial`` more.

    The order is cut into ranges by the leading digits of the hash, about ``RANGE_ROWS`` rows
    each, also within a source that holds a third of all rows. Sums per range, added up over
    the ranges before it, are the offsets of the running sums inside the ranges. Repeated rows
    are one row by then.
    """
    # Rows without an id are told apart by their text.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col(TEXT_HASH).cast("string")))
    rows = _keyed(docs).select(
        F.col("doc_id"), ORIGIN, ID, TEXT_HASH, F.md5(F.concat(F.lit(f"{seed}:"), name)).alias(KEY),
        word_count(whole_text()).alias("size"),
    )
    rows = written(
        rows.groupBy(ORIGIN, ID, TEXT_HASH, KEY, "size").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    )
    words = F.col("size") * F.col("n")
    by_source = rows.groupBy(ORIGIN).agg(F.sum(words).alias("source_size"), F.count("*").alias("_n"))
    by_source = written(by_source)
    largest = by_source.agg(F.max("_n")).first()[0] or 1
    digits = max(0, math.ceil(math.log(largest / RANGE_ROWS, 16))) if largest > RANGE_ROWS else 0
    rows = rows.withColumn(RANGE, F.substring(KEY, 1, digits))
    before = Window.partitionBy(ORIGIN).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(ORIGIN, RANGE)
        .agg(F.sum(words).alias("_in_range"))
        .select(ORIGIN, RANGE, F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy(ORIGIN, RANGE)
        .orderBy(KEY, ID, "size", TEXT_HASH)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        rows.withColumn("_upto", F.sum(words).over(inside))
        .join(offsets, [ORIGIN, RANGE])
        .join(targets(by_source.drop("_n"), weights, share, repeats), ORIGIN)
    )
    budget = F.floor(F.col("target") + 0.5)
    rounds = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0)
    left = F.col("_budget") - F.col("_rounds") * F.col("source_size")
    start = F.col("_offset") + F.col("_upto") - words
    return (
        placed.withColumn("_budget", budget)
        .withColumn("_rounds", rounds)
        .withColumn("_more", F.least(F.greatest(left - start, F.lit(0)), words).cast("bigint"))
        .select(
            ORIGIN, ID, TEXT_HASH, "doc_id", "n", "size", "source_size", "target",
            (F.col("_rounds") * F.col("size")).cast("bigint").alias("base"),
            F.when(F.col("size") > 0, F.expr("_more div size")).otherwise(0).cast("bigint").alias("full"),
            F.when(F.col("size") > 0, F.col("_more") % F.col("size")).otherwise(0).cast("bigint").alias("partial"),
        )
    )


def _taken(place: Column) -> Column:
    """Words taken of the row that has that place (from 0) among its copies."""
    more = F.when(place < F.col("full"), F.col("size")).when(place == F.col("full"), F.col("partial")).otherwise(0)
    return (F.col("base") + more).cast("bigint")


def take(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = 0,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    Rows of a source are in the order of a hash of id and seed. A source's budget is its
    target to the nearest word; whole rounds through the source come first, and the rows up
    to the rest of the budget are taken once more, the last of them in part. Reruns agree
    however the table is cut into partitions. A null or blank text has size 0, a text of any length
    its number of words; a null source is a source, the last; rows without an id have their place by
    their text, and repeated rows count one by one. An empty table gives no rows; further columns,
    whatever their names, are not read.
    """
    amounts = written(_amounts(docs, weights, share, repeats, seed))
    columns = ["doc_id", "size", "source_size", "target"]
    zero = F.lit(0).cast("bigint")
    few = amounts.filter(F.col("n") <= COPIES).withColumn("_i", F.explode(F.sequence(zero, F.col("n") - 1)))
    # A row with very many copies is unfolded in several tasks.
    many = amounts.filter(F.col("n") > COPIES)
    parts = many.withColumn("_p", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / COPIES))))
    first = F.col("_p") * COPIES
    each = parts.repartition("_p", TEXT_HASH).withColumn(
        "_i", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1))
    )
    rows = few.unionByName(each.drop("_p"))
    return rows.select(*columns, _taken(F.col("_i")).alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    return take(docs).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its word number ``count``."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), count), "")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, one for each time they are taken.

    ``epoch`` (from 1) and ``taken`` are added and replace columns of those names. The row
    that a source's budget ends in has its text cut after the last word taken. Rows without
    a word are taken in no epoch and go.
    """
    amounts = written(
        _amounts(docs, how.get("weights", WEIGHTS), how.get("share", SHARE), how.get("repeats", REPEATS), how.get("seed", 0))
    )
    keys = [ORIGIN, ID, TEXT_HASH]
    amount = F.struct("n", "size", "base", "full", "partial").alias("_mix")
    joined = _keyed(docs).join(amounts.select(*keys, amount), keys)
    full, n = F.col("_mix.full"), F.col("_mix.n")
    uneven = (n > 1) & (((full > 0) & (full < n)) | (F.col("_mix.partial") > 0))
    # All copies of a row are taken alike, but for those that a source's budget ends in: one row of a
    # source. Only its copies are numbered.
    alike = joined.filter(~uneven).withColumn("_mix_i", F.lit(0).cast("bigint"))
    rest = joined.filter(uneven).withColumn("_mix_row", F.monotonically_increasing_id())
    n_rest = amounts.filter((F.col("n") > 1) & (((F.col("full") > 0) & (F.col("full") < F.col("n"))) | (F.col("partial") > 0)))
    n_rest = n_rest.agg(F.sum("n")).first()[0]
    if n_rest:
        placed = in_order(rest, n_rest, *keys, "_mix_row").drop("_mix_row")
        first = placed.groupBy(*keys).agg(F.min("_at").alias("_mix_first"))
        placed = placed.join(first, keys).withColumn("_mix_i", F.col("_at") - F.col("_mix_first"))
        alike = alike.unionByName(placed.drop("_at", "_mix_first"))
    place, size = F.col("_mix_i"), F.col("_mix.size")
    more = F.when(place < full, size).when(place == full, F.col("_mix.partial")).otherwise(0)
    taken = F.col("_mix_taken")
    epochs = F.when(taken > 0, F.sequence(F.lit(1), F.ceil(taken / size).cast("int")))
    one = F.least(size, taken - (F.col("epoch") - 1) * size)
    return (
        alike.withColumn("_mix_taken", (F.col("_mix.base") + more).cast("bigint"))
        .withColumn("epoch", F.explode(epochs))
        .withColumn("taken", one)
        .withColumn(
            "text", F.when(one < size, first_words(F.col("text"), one.cast("int"))).otherwise(F.col("text"))
        )
        .drop(*keys, "_mix", "_mix_i", "_mix_taken")
    )


ORACLE_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, md5('0:' || doc_id) AS k,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
    SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM sources
), weighed AS (
    SELECT *, CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM ranked
), filled AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
           sum(cap) OVER s AS caps, sum(w) OVER () - sum(w) OVER s AS rest
    FROM weighed
    WINDOW s AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), marked AS (
    SELECT *, (caps * w + cap * rest)::DOUBLE <= total * w AS is_full FROM filled
), dealt AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN cap::DOUBLE
                ELSE (total - (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE) * w
                     / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
    FROM marked
), placed AS (
    SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
           sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
    FROM sized s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(greatest(CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - start, 0), size)
       )::BIGINT AS taken
FROM placed
"""
