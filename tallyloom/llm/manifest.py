"""Merkle manifest of a dataset: one hash for all, and a proof for every row.

Rows are leaves. Level by level, conditional aggregates spread the children of a parent into
one column a slot; the columns put together give the parent's hash, and without a child's own
slot they are its siblings. Each group of rows (a source) has a tree, and the roots of those
trees have one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import id_remainder, written
from tallyloom.llm.sql import crc32_sql

FANOUT = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one range when rows are put in order; ranges are at least as many as shuffle partitions.
RANGE_ROWS = 500_000
#: Levels that the SQL counterpart unfolds: 3^20 rows of a source.
SQL_LEVELS = 20
#: monotonically_increasing_id(): the number within its partition has so many bits.
_INDEX_BITS = 33
_PATH = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """``rows``: a row per leaf with the columns kept, ``leaf``, ``subroot``, ``root`` and
    ``path`` (left and right siblings, from the leaf's level upwards). ``groups``: a row per
    group with ``label`` (empty for a null group, else ``=`` and its name), ``subroot``, ``root``.
    ``levels``: the stored nodes of the groups' trees, leaves first."""

    rows: DataFrame
    groups: DataFrame
    levels: list[DataFrame]


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return hashed(*[encoded(v) for v in values])


def in_order(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The rows with ``_at``, their place from 0 in the order of the columns, nulls first.

    Rows are dealt to ranges and sorted there; a place is that within the range and the sizes
    of the ranges before. Only the sizes of ranges meet in one task.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / RANGE_ROWS))
    by = [F.asc_nulls_first(c) for c in order]
    dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    dealt = written(dealt.withColumn("_at_id", F.monotonically_increasing_id()))
    index, part = F.col("_at_id").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)), F.shiftright("_at_id", _INDEX_BITS)
    sizes = dealt.groupBy(part.alias("_at_part")).agg(F.count("*").alias("_at_size"))
    before = sizes.select(
        "_at_part",
        F.expr(
            "sum(_at_size) over (order by _at_part rows between unbounded preceding and current row) - _at_size"
        ).alias("_at_before"),
    )
    placed = dealt.withColumn("_at_part", part).join(before, "_at_part")
    return placed.withColumn("_at", F.col("_at_before") + index).drop("_at_id", "_at_part", "_at_before")


def climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """All levels over ``nodes`` (``g``, ``pos`` from 0, ``n`` nodes of the group, ``h``).

    A level has its own ``g``, ``pos``, ``n``, ``h`` and the children's hashes ``c0``, ``c1``...
    A group ends at the level where it has one node. ``largest`` is the greatest ``n``.
    """
    levels, n = [nodes], largest
    while n > 1:
        parent = F.floor(F.col("pos") / FANOUT).alias("pos")
        slots = [F.max(F.when(F.col("pos") % FANOUT == s, F.col("h"))).alias(f"c{s}") for s in range(FANOUT)]
        grouped = levels[-1].filter("n > 1").groupBy("g", "n", parent).agg(*slots)
        levels.append(
            written(
                grouped.withColumn("n", F.ceil(F.col("n") / FANOUT)).withColumn(
                    "h", hashed(*[F.col(f"c{s}") for s in range(FANOUT)])
                )
            )
        )
        n = math.ceil(n / FANOUT)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """``g`` and ``h`` of the last node of every group."""
    found = levels[0].filter("n = 1").select("g", "h")
    for level in levels[1:]:
        found = found.unionByName(level.filter("n = 1").select("g", "h"))
    return found


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest level with ``path``; ``above`` gives every ``g`` the path of its
    last node and further columns, which are handed down."""
    handed = [c for c in above.columns if c not in ("g", "path")]
    below = None
    for level in reversed(levels):
        rows = level.filter("n = 1").join(above, "g")
        if below is not None:
            slot = F.col("pos") % FANOUT
            left = F.concat_ws("", *[F.when(slot > s, F.col(f"up.c{s}")) for s in range(FANOUT)])
            right = F.concat_ws("", *[F.when(slot < s, F.col(f"up.c{s}")) for s in range(FANOUT)])
            own = F.array(F.struct(left.alias("left"), right.alias("right")))
            parents = below.select(
                "g", F.col("pos").alias("_parent"),
                F.struct("path", *handed, *[f"c{s}" for s in range(FANOUT)]).alias("up"),
            )
            inner = (
                level.filter("n > 1").withColumn("_parent", F.floor(F.col("pos") / FANOUT))
                .join(parents, ["g", "_parent"])
                .withColumns({"path": F.concat(own, F.col("up.path")), **{c: F.col(f"up.{c}") for c in handed}})
                .drop("up", "_parent")
            )
            rows = rows.unionByName(inner)
        below = rows
    return below


def manifest(
    docs: DataFrame, kept: dict[str, Column], columns: Sequence[str] = LEAF_COLUMNS,
    group: str = "source", order: str = "doc_id",
) -> Manifest:
    """The manifest of ``docs``: leaves are rows, hashed over ``columns``; ``kept`` names what
    else a row of the result holds (any expressions over ``docs``).

    Within a group leaves ascend by ``order`` (nulls first), then by hash; groups ascend by their
    bytes, null first. Nulls in hashed columns count as ``-``, an empty text as ``0:``. Repeated
    rows are leaves of their own, side by side. An empty table has no rows, no groups and no
    root. Texts are hashed where they are read, whole, and never shuffled. Other columns of
    ``docs``, whatever their names, are not read.
    """
    label = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = written(
        docs.select(
            label.alias("g"), F.col(order).alias("_order"),
            leaf_hash([F.col(c) for c in columns]).alias("h"),
            *[e.alias(f"kept_{c}") for c, e in kept.items()],
            # Equal rows, however many, are dealt to several ranges.
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    placed = in_order(leaves, leaves.count(), "g", "_order", "h", "_row")
    placed = written(placed.drop("_order", "_row"))
    sizes = written(placed.groupBy("g").agg(F.min("_at").alias("_first"), F.count("*").alias("n")))
    nodes = placed.join(sizes, "g").withColumn("pos", F.col("_at") - F.col("_first")).drop("_at", "_first")
    nodes = written(nodes)
    levels = climb(nodes, sizes.agg(F.max("n")).first()[0] or 0)

    ends = written(tops(levels))
    n = ends.count()
    roots = in_order(ends, n, "g").select(
        F.lit(0).alias("g"), F.col("_at").alias("pos"), F.lit(n).cast("bigint").alias("n"), "h", F.col("g").alias("label")
    )
    upper = climb(written(roots), n)
    top = tops(upper).select("g", F.array().cast(_PATH).alias("path"), F.col("h").alias("root"))
    groups = written(descend(upper, top).select("label", F.col("h").alias("subroot"), "root", "path"))
    rows = descend(levels, groups.withColumnRenamed("label", "g"))
    return Manifest(
        rows.select(*[F.col(f"kept_{c}").alias(c) for c in kept], F.col("h").alias("leaf"), "subroot", "root", "path"),
        groups.select("label", "subroot", "root"),
        levels,
    )


def proof_hash(path: str = "path") -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest_report(docs: DataFrame) -> DataFrame:
    """A row per document: its leaf, subroot, root, the hash of its proof, and whether the row
    as found later (every second one has lost its line ends, by crc32 of its id; rows
    without an id are as they were) still leads to the root. Nulls, empty texts, repeated rows
    and empty tables: as for ``manifest``."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    values = [text if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    changed = F.when(id_remainder(2) == 0, leaf_hash(values))
    rows = manifest(docs, {"doc_id": F.col("doc_id").cast("bigint"), "changed": changed}).rows
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_hash().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _tree_sql(name: str, depth: int) -> str:
    """Levels ``{name}0`` to ``{name}{depth}`` over ``{name}0`` (g, pos, n, h), each with its families."""
    steps = []
    for k in range(depth):
        steps.append(
            f"{name}f{k} AS MATERIALIZED (SELECT g, pos // {FANOUT} AS pos, n, list(h ORDER BY pos) AS hs "
            f"FROM {name}{k} GROUP BY g, pos // {FANOUT}, n)"
        )
        steps.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT g, pos, (n + {FANOUT - 1}) // {FANOUT} AS n, "
            f"CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}f{k})"
        )
    return ",\n".join(steps)


def _walk_sql(name: str, tree: str, depth: int) -> str:
    """``{name}{depth}``: rows of ``{name}0`` (rid, g, pos, h, proof) taken up the tree."""
    steps = []
    for k in range(depth):
        left = f"array_to_string(f.hs[1:w.pos % {FANOUT}], '')"
        right = f"array_to_string(f.hs[w.pos % {FANOUT} + 2:], '')"
        steps.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT w.rid, w.g, w.pos // {FANOUT} AS pos, "
            f"CASE WHEN f.n = 1 THEN w.h ELSE sha256({left} || w.h || {right}) END AS h, "
            f"CASE WHEN f.n = 1 THEN w.proof ELSE w.proof || {left} || {right} END AS proof "
            f"FROM {name}{k} w JOIN {tree}f{k} f ON f.g = w.g AND f.pos = w.pos // {FANOUT})"
        )
    return ",\n".join(steps)


def _leaf_sql(text: str) -> str:
    values = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF_COLUMNS]
    parts = [f"coalesce(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS g, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed
  FROM documents),
p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM d),
t0 AS MATERIALIZED (SELECT g, pos, n, leaf AS h FROM p),
{_tree_sql("t", SQL_LEVELS)},
s AS MATERIALIZED (
  SELECT g AS label, 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, h FROM t{SQL_LEVELS}),
u0 AS MATERIALIZED (SELECT g, pos, n, h FROM s),
{_tree_sql("u", SQL_LEVELS)},
w0 AS MATERIALIZED (SELECT rid, g, pos, coalesce(changed, leaf) AS h, '' AS proof FROM p),
{_walk_sql("w", "t", SQL_LEVELS)},
v0 AS MATERIALIZED (SELECT w.rid, s.g, s.pos, w.h, w.proof FROM w{SQL_LEVELS} w JOIN s ON s.label = w.g),
{_walk_sql("v", "u", SQL_LEVELS)}
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = r.h AS verified
FROM v{SQL_LEVELS} v JOIN p ON p.rid = v.rid JOIN s ON s.label = p.g JOIN u{SQL_LEVELS} r ON r.g = v.g
"""
