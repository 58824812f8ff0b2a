"""Connected components of a graph of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import removed, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (two columns of bigint); the root is the
    smallest node of the component.

    Each round ties the larger neighbours of a node to the smallest one (large star), then
    the smaller ones (small star), until nothing moves; the number of rounds grows with the
    logarithm of the largest distance. Only aggregates and joins on a node are used, so a
    node with very many links is split like any other hot key. Every round is stored, so a
    lost executor costs one round, and replaces the round before. No links give no rows.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, path = stored(edges.filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = stored(large.filter("u <> v").distinct())
        lower = _least(large)
        small = (
            large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
        )
        replaced = (path, large_path)
        edges, path = stored(small.filter("u <> v").distinct())
        for old in replaced:  # nothing reads them any more
            removed(links.sparkSession, old)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
