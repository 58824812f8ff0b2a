"""SimHash near-dedup by an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most four bits have at least four of their eight
bytes in common. Posting lists are kept for byte positions taken three at a time, chosen so
that any four common positions hold one of the triples: such a pair meets in at least one
list. There the shared positional bytes of each pair are tallied, pairs with the guaranteed
number go on, and their differing bits are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.shared import NO_ID, ascii_lower, known_id, text_hash, whole_text, words, written

MAX_BITS = 4
BYTES = 8
WIDTH = 4
#: Postings that one task group should hold; lists beyond twice that are compared in blocks.
GROUP_ROWS = 4096
HASHES_AT_A_TIME = 1 << 16
LINKS_AT_A_TIME = 1 << 18


def position_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the eight positions; every four positions contain one of them.

    With the positions in three parts: those inside a part, and two of a part with one of the
    next. Four positions have three in one part, or two in one and one in the next.
    """
    part = [i * 3 // BYTES for i in range(BYTES)]
    return [
        t
        for t in combinations(range(BYTES), 3)
        if len({part[p] for p in t}) == 1
        or any(
            sum(part[p] == k for p in t) == 2 and sum(part[p] == (k + 1) % 3 for p in t) == 1
            for k in range(3)
        )
    ]


def shingle_hashes(text: Column, width: int) -> Column:
    """XXH64 (seed 42) of every shingle of ``width`` words; the whole sequence if it is shorter."""

    def of_row(row: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(row) - width + 1, F.lit(1))),
            lambda i: F.xxhash64(F.array_join(F.slice(row, i, F.lit(width)), " ")),
        )
        return F.when(F.size(row) == 0, F.array().cast("array<bigint>")).otherwise(parts)

    return F.transform(F.array(words(ascii_lower(text))), of_row)[0]


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in more than half of the hashes, as a signed integer."""
    total = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), HASHES_AT_A_TIME):
        part = np.ascontiguousarray(hashes[start : start + HASHES_AT_A_TIME])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, names: str, hashes: Column) -> DataFrame:
    """Columns ``names`` of ``rows`` and ``fp``, the fingerprint of the shingle hashes."""
    kept = [n.strip() for n in names.split(",")]
    schema = ", ".join(f"`{n}` {dict(rows.dtypes)[n]}" for n in kept) + ", fp bigint"

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("h")
            values = column.values.to_numpy(zero_copy_only=False)
            ends = column.offsets.to_numpy()
            found = [majority(values[ends[r] : ends[r + 1]]) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(found, pa.int64())], names=[*kept, "fp"]
            )

    return rows.select(*kept, hashes.alias("h")).mapInArrow(printed, schema)


def _forest(a: np.ndarray, b: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that join all that the links join, the closest ones first."""
    label, chosen = np.arange(n), []
    for level in np.unique(bits):
        todo = np.nonzero(bits == level)[0]
        while True:
            la, lb = label[a[todo]], label[b[todo]]
            open_ = la != lb
            todo, la, lb = todo[open_], la[open_], lb[open_]
            if not len(todo):
                break
            # Every component takes its link to the smallest other one: no cycle but of two.
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            first = np.lexsort((low, high))
            first = first[np.append(True, high[first][1:] != high[first][:-1])]
            chosen.append(todo[first])
            to = np.arange(n)
            to[high[first]] = low[first]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def links_of_postings(
    code: np.ndarray, fp: np.ndarray, node: np.ndarray, block: np.ndarray, max_bits: int
) -> pd.DataFrame:
    """A forest of the links within the posting lists of one group, the closest ones first. Of
    two blocks only links from one to the other are looked for."""
    order = np.lexsort((node, code))
    code, fp, node, block = code[order], fp[order].view(np.uint64), node[order], block[order]
    two_blocks = len(block) > 0 and block.min() != block.max()
    a, b, bits = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def fewer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
        kept = _forest(ids[: len(a)], ids[len(a) :], bits, len(nodes))
        return a[kept], b[kept], bits[kept]

    for step in range(1, len(code)):
        i = np.nonzero(code[step:] == code[:-step])[0]
        if not len(i):
            break
        differ = fp[i] ^ fp[i + step]
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = (shared >= BYTES - max_bits) & (node[i] != node[i + step])
        if two_blocks:
            near &= block[i] != block[i + step]
        apart = np.bitwise_count(differ).astype(np.int64)
        near &= apart <= max_bits
        i = i[near]
        a, b, bits = np.append(a, node[i]), np.append(b, node[i + step]), np.append(bits, apart[near])
        if len(a) > LINKS_AT_A_TIME:
            a, b, bits = fewer()
    a, b, bits = fewer()
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "bits": bits})


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b, bits): enough links to join all ``node`` s of ``prints``, a stored table with one row
    per node, that are joined by fingerprints ``fp`` of ``max_bits`` or fewer differing bits.

    Postings are grouped by a hash of their list, a bounded number of rows each. A group that
    a long list makes larger is cut into blocks by node, and every two blocks are compared in
    a task group of their own, so no list is ever held as a whole. From each group only a
    forest comes back: closest links first, at most one per node and list.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must lie between 0 and {MAX_BITS}")
    fp = F.col("fp")
    codes = [
        sum(
            (F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(255), 8 * i) for i, p in enumerate(t)),
            F.lit(number << 24).cast("bigint"),
        )
        for number, t in enumerate(position_triples())
    ]
    groups = max(1, math.ceil(prints.count() * len(codes) / GROUP_ROWS))
    postings = prints.select("node", "fp", F.explode(F.array(*codes)).alias("code")).select(
        F.pmod(F.xxhash64("code"), F.lit(groups)).alias("g"), "code", "fp", "node"
    )
    crowded = written(
        postings.groupBy("g").count().filter(F.col("count") > 2 * GROUP_ROWS)
        .select("g", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        postings.join(crowded, "g", "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select(
            "g", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            "code", "fp", "node", "own",
        )
    )

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        return links_of_postings(*(group[c].to_numpy() for c in ("code", "fp", "node", "own")), max_bits)

    return dealt.groupBy("g", "low", "high").applyInPandas(linked, "a bigint, b bigint, bits bigint").distinct()


ID, TEXT_HASH = "_simhash_id", "_simhash_th"


def _grouped(docs: DataFrame, width: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ID, TEXT_HASH and ``fp`` of every row; ``fp`` and ``root``, a fingerprint of its
    group, of every fingerprint. Both are stored.

    Equal fingerprints become one node before anything is compared, so exact copies cost
    nothing further.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), known_id().alias(ID), text_hash().alias(TEXT_HASH),
        whole_text().alias("text"),
    )
    made = fingerprints(rows, f"doc_id, {ID}, {TEXT_HASH}", shingle_hashes(F.col("text"), width))
    prints = written(made)
    nodes = written(prints.select("fp").distinct())
    links = near_links(nodes.select(F.col("fp").alias("node"), "fp"), max_bits)
    member = components(links.select("a", "b")).select(F.col("node").alias("fp"), "root")
    return prints, written(nodes.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def fingerprint_groups(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row.

    Texts are lower-cased (A-Z), their shingles of ``width`` words hashed with XXH64, and a bit
    of the fingerprint is 1 if it is in over half of the hashes, repeats included. A text of
    fewer words is one shingle; a text without a word (null, empty, blank) has fingerprint 0
    and is linked like any other. Rows link at ``max_bits`` or fewer differing bits;
    ``component_id`` is the smallest id reachable (null if all are null). Repeated rows and ids
    give a row each; other columns are not read; texts of any length are read whole. An empty table gives no rows.
    """
    prints, placed = _grouped(docs, width, max_bits)
    nodes = prints.groupBy("fp").agg(F.min(ID).alias("least"))
    smallest = nodes.join(placed, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.nullif("component_id", F.lit(NO_ID)).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of ``fingerprint_groups``: the one with the smallest id
    (of equal ids the one with the smallest hash of its text), once.

    Null ids come after all others. Texts without a word have fingerprint 0 and are one group
    with all that is near it. Repeated rows are one row. All columns are returned as they are,
    whatever their names; an empty table gives no rows. Texts are shuffled only where rows
    repeat throughout, or where more rows go than can be sent to all executors.
    """
    prints, placed = _grouped(docs, width, max_bits)
    name = F.struct(ID, TEXT_HASH)
    nodes = prints.groupBy("fp").agg(F.min(name).alias("first"))
    firsts = nodes.join(placed, "fp").groupBy("root").agg(F.min("first").alias("first"))
    of_print = placed.join(firsts, "root").select("fp", "first")
    # Rows are counted by fingerprint and name first, so no group's copies meet in one task.
    rows = prints.groupBy("fp", ID, TEXT_HASH).agg(F.count("*").alias("n")).join(of_print, "fp")
    rows = written(rows.select(ID, TEXT_HASH, "n", (name == F.col("first")).alias("stays")))
    keyed = docs.withColumns({ID: known_id(), TEXT_HASH: text_hash()})
    once = rows.filter(F.col("stays") & (F.col("n") > 1)).select(ID, TEXT_HASH)
    aside = rows.filter(~F.col("stays")).select(ID, TEXT_HASH).unionByName(once)
    single = keyed.join(aside, [ID, TEXT_HASH], "left_anti")
    repeated = keyed.join(once, [ID, TEXT_HASH], "left_semi").dropDuplicates([ID, TEXT_HASH])
    return single.unionByName(repeated).drop(ID, TEXT_HASH)
