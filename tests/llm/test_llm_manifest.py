import hashlib
import zlib
from collections import defaultdict

import pytest
from awkward import TEXTS, documents, none
from pyspark.sql import functions as F

from tallyloom.llm import manifest as module
from tallyloom.llm.manifest import FANOUT, in_order, manifest, manifest_report


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """The root, and for every leaf its siblings: (left, right) by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // FANOUT * FANOUT
            paths[i].append((level[run:place], level[place + 1 : run + FANOUT]))
            at[i] = place // FANOUT
        level = [H(*level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0], paths


def by_hand(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    found = []
    for s, up in zip(names, above):
        subroot, paths = trees[s]
        for (_, _, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), paths):
            start = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                start = leaf((*r[:4], r[4] if r[4] is None else r[4].replace("\n", "")))
            proof = ""
            for left, right in path + up:
                proof += "".join(left + right)
                start = H(*left, start, *right)
            found.append((r[0], own, subroot, root, H(proof), start, start == root))
    return sorted(found, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_awkward_rows(spark):
    docs = documents(spark)
    got = manifest_report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result(got) == by_hand(rows_of(docs))
    assert {r.verified for r in got.collect()} == {True, False}
    assert manifest_report(none(docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_of_one_source(spark, n):
    docs = documents(spark, [(i, f"t{i}\nx", "en", "only") for i in range(n)])
    assert result(manifest_report(docs)) == by_hand(rows_of(docs))


def test_many_sources_repeated_rows_and_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(module, "RANGE_ROWS", 7)
    rows = [(i % 40, f"t{i % 90}\n", "en", f"s{i * i % 31}" if i % 31 else None) for i in range(400)]
    rows += [(7, "same", None, "hot")] * 200
    docs = documents(spark, rows)
    assert result(manifest_report(docs)) == by_hand(rows_of(docs))


def test_any_change_breaks_the_proof(spark):
    docs = documents(spark, [r for r in TEXTS if r[0] is not None])
    made = manifest(docs, {"doc_id": F.col("doc_id")})
    root = made.groups.first().root
    assert {r.root for r in made.rows.collect()} == {root}
    for column, value in (("text", F.concat("text", F.lit(" "))), ("lang", F.lit("xx")), ("n_chars", F.col("n_chars") + 1)):
        other = docs.withColumn(column, F.when(F.col("doc_id") == 7, value).otherwise(F.col(column)))
        assert manifest(other, {}).groups.first().root != root
    assert manifest(docs.repartition(5), {}).groups.first().root == root


def test_order_of_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("s"))
    got = in_order(df, 5000, "s", "k").collect()
    assert all(r._at == r.k for r in got) and len(got) == 5000
