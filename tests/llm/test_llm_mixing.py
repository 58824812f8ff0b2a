import hashlib
import re

import pytest
import xxhash
from awkward import TEXTS, documents, none, rows
from comparing import database, differences

from tallyloom.llm import mixing
from tallyloom.llm.mixing import mix_report, mixed
from tallyloom.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def shares(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Targets by dealing out again what is over, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        deal = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if deal[s] > repeats * sizes[s]}
        if not over:
            return {s: deal.get(s, repeats * sizes[s]) for s in names}
        full |= over


def place(doc_id, text):
    """The hash a row has its place by; rows without an id go by their text."""
    if doc_id is None:
        bits = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        doc_id = f"null:{bits - (bits >> 63 << 64)}"
    return hashlib.md5(f"0:{doc_id}".encode()).hexdigest()


def by_hand(table):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = {}
    for i, t, _, s in table:
        by_source.setdefault(s, []).append((i, size(t), t))
    target = shares({s: sum(n for _, n, _ in d) for s, d in by_source.items()})
    found = []
    for s, docs in by_source.items():
        whole = sum(n for _, n, _ in docs)
        budget = int(target[s] + 0.5)
        rounds, left = divmod(budget, whole) if whole else (0, 0)
        for i, n, t in sorted(docs, key=lambda d: (place(d[0], d[2]), d[1])):
            part = max(0, min(left, n))
            left -= part
            found.append((i, n, whole, target[s], rounds * n + part))
    return found


def test_same_as_sql(spark):
    con = database(FOLDER)
    assert differences(mix_report(table(spark, FOLDER, "documents")), con, mixing.ORACLE_SQL) == ""


@pytest.mark.parametrize("range_rows", [4096, 16, 1])
def test_ranges_do_not_change_the_result(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    docs = [(i, "w " * (i % 7), None, "ab"[i % 3 > 0]) for i in range(120)]
    got = rows(mix_report(documents(spark, docs)), "doc_id", "size", "source_size", "target", "taken")
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in sorted(by_hand(docs))]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(by_hand(docs))])


def test_awkward_rows(spark):
    docs = documents(spark)
    got = mix_report(docs).collect()
    wanted = by_hand(TEXTS)
    assert sorted((r.size, r.source_size, r.taken) for r in got) == sorted((w[1], w[2], w[4]) for w in wanted)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in {r.source_size for r in got}:
        of = [r for r in got if r.source_size == s]
        assert abs(sum(r.taken for r in of) - sum({r.target for r in of})) < 1 or len({r.target for r in of}) > 1
    again = mixed(docs)
    assert sum(r.taken for r in again.collect()) == sum(r.taken for r in got)
    for r in again.collect():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.taken
        assert r.epoch in (1, 2)
    assert set(docs.columns) <= set(again.columns)
    assert mix_report(none(docs)).count() == mixed(none(docs)).count() == 0


def test_sources_keep_their_share_on_other_partitions(spark):
    docs = table(spark, FOLDER, "documents")
    first = rows(mix_report(docs), "doc_id", "taken")
    assert rows(mix_report(docs.repartition(13)), "doc_id", "taken") == first


def test_no_words_at_all(spark):
    got = mix_report(documents(spark, [(1, "", None, "a"), (2, None, None, None)]))
    assert rows(got, "doc_id", "taken") == [(1, 0), (2, 0)]


@pytest.mark.parametrize("copies", [4096, 7])
def test_many_copies_of_a_row_and_many_rows_without_an_id(spark, monkeypatch, copies):
    """The budget of source a ends among copies; rows without an id are spread by their text."""
    monkeypatch.setattr(mixing, "COPIES", copies)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    docs = [(1, "one two three", None, "a")] * 60 + [(i, "w " * (i % 9), None, "a") for i in range(2, 40)]
    docs += [(None, f"text number {i} here", None, "b") for i in range(80)] + [(None, None, None, "b")] * 30 + [(99, "x y", None, "c")] * 5
    df = documents(spark, docs)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3], r[4])
    got = sorted(map(tuple, mix_report(df).collect()), key=key)
    wanted = sorted(by_hand(docs), key=key)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in wanted]
    taken = {}
    for r in mixed(df).collect():
        assert len(r.text.split()) == r.taken
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
    source = {i: s for i, _, _, s in docs}
    sums = {}
    for i, _, _, _, n in by_hand(docs):
        sums[i, source[i]] = sums.get((i, source[i]), 0) + n
    assert taken == {k: v for k, v in sums.items() if v}
