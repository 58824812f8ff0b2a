import re
import zlib
from collections import Counter

import numpy as np
import pytest
from awkward import documents, none
from hypothesis import given
from hypothesis import strategies as st

from tallyloom.llm import spelling
from tallyloom.llm.spelling import (
    Pairs, affected_by_one_edit, cut_into_grams, listed_under, near_words, one_edit_apart, variant_report,
    variants, vocabulary,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def edited(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1 :]
        yield word[:i] + word[i + 1 :]


def by_hand(words):
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in edited(w, letters) if x in words and x != w} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    root = {}
    for w in words:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return {w: (words[w], len(near[w]), form[w], words.get(form[w]), root[w]) for w in words}


def result(df):
    rows = df.collect()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(found) == len(rows)
    return found


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint")


def dense(dice, n=900, letters="ab"):
    """Words of few letters, so that most have near words; counts far apart."""
    words = {"".join(dice.choice(list(letters), dice.integers(7, 12))) for _ in range(n)}
    return {w: int(10 ** dice.integers(0, 4) * dice.integers(1, 9)) + 1 for w in sorted(words)}


@pytest.mark.parametrize("list_words, frequent, paired, group", [(64, 50_000, 256, 100_000), (2, 50_000, 3, 500), (1, 30, 10, 100_000)])
def test_same_as_comparing_all(spark, monkeypatch, list_words, frequent, paired, group):
    """Any dictionary, short and long lists, one or many groups."""
    for name, value in (("LIST_WORDS", list_words), ("FREQUENT", frequent), ("PAIRED_WORDS", paired), ("GROUP_ROWS", group)):
        monkeypatch.setattr(spelling, name, value)
    words = dense(np.random.default_rng(1))
    wanted = by_hand(words)
    assert sum(w[1] > 0 for w in wanted.values()) > 300 and sum(w[4] != w[2] is not None for w in wanted.values()) > 3
    assert result(variants(frame(spark, words))) == wanted


def test_report_over_awkward_texts(spark):
    long = "é" * 5000
    texts = ["Straße strasse Strasse STRASSE écoles École écoles", "orthography " * 60 + "ortography orthographyx Orthography",
             "ortography Ôrthography ôrthography ortography", f"{long} {long}a {long} {long}a", None, "", "abc abcdefg7abcdefg", "ÀÈÌÒÙàè×÷ÿ ÀÈÌÒÙàè×÷ÿ"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(1, texts[1], "en", "a"), (None, texts[1], None, None)]
    docs = documents(spark, rows)
    wanted = by_hand(words_by_hand([r[:2] for r in rows]))
    assert wanted["ortography"][2] == "orthography" and wanted[long][1] == 1
    assert result(variant_report(docs)) == wanted
    assert variant_report(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_same_on_the_table(spark):
    from tallyloom.sources.tables import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    words = words_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.word: r.n for r in vocabulary(docs).collect()} == words
    assert result(variant_report(docs)) == by_hand(words)


def test_empty_tables(spark):
    docs = documents(spark)
    assert variant_report(none(docs)).count() == 0
    assert variant_report(documents(spark, [(1, "one two", "en", "a")])).count() == 0
    assert near_words(frame(spark, {"abcdefg": 1}).filter("n > 1")).count() == 0


def test_ties_go_to_the_first_by_code_point(spark):
    words = {"abcdefg": 2, "abcdefz": 30, "abcdefé": 30, "abcdefgh": 29}
    assert result(variants(frame(spark, words)))["abcdefg"][2] == "abcdefz"


FEW = st.text("ab", min_size=7, max_size=16)


@given(FEW, st.sets(st.text("ab", min_size=2, max_size=5), max_size=40), st.integers(0, 16), st.sampled_from("ab"), st.integers(0, 2))
def test_near_words_share_a_list(word, frequent, at, letter, kind):
    """Whatever is frequent: a word and one that is an edit away stand in one list at least, and
    share as many grams (with what is before or after them) as the bound says."""
    at = min(at, len(word) - (kind > 0))
    other = word[:at] + (letter if kind < 2 else "") + word[at + (kind > 0) :]
    if other == word or len(other) < 7:
        return
    counts = {g: len(g) for g in frequent}
    endings = {g[k:] for g in frequent for k in range(1, len(g))}
    lists = [{key for key, _, _ in listed_under(w, counts, endings)} for w in (word, other)]
    assert lists[0] & lists[1]
    longest = spelling.level_of(min(len(word), len(other)))
    cut = [cut_into_grams(w, longest, counts) for w in (word, other)]
    before = [{(e, w[:e], s) for s, e in c} for w, c in zip((word, other), cut)]
    after = [{(len(w) - s, w[s:], e - s) for s, e in c} for w, c in zip((word, other), cut)]
    shared = len({x[2] for x in before[0] & before[1]} | {len(word) - x[0] for x in after[0] & after[1]})
    for w, c in zip((word, other), cut):
        assert shared >= len(c) - affected_by_one_edit(w, c, longest, endings) >= 1


@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=2, max_size=8, unique=True), st.integers(0, 40))
def test_verification(words, extra):
    words = sorted({w + "x" * extra for w in words} | {"y" * extra + w for w in words})
    pairs = Pairs(words)
    a, b = np.triu_indices(len(words), 1)
    letters = "abéxy"
    wanted = [words[j] in set(edited(words[i], letters)) for i, j in zip(a, b)]
    assert [one_edit_apart(words[i], words[j]) for i, j in zip(a, b)] == wanted
    assert set(pairs.near(a, b)) == set(np.flatnonzero(wanted))


@given(FEW, st.integers(0, 16), st.sampled_from("ab"), st.integers(0, 2), st.integers(0, 8), st.integers(0, 8))
def test_near_words_of_a_list_share_one_of_its_parts(word, at, letter, kind, before, after):
    """However often a list is cut, down to parts that are cut no more."""
    at = min(at, len(word) - (kind > 0))
    other = word[:at] + (letter if kind < 2 else "") + word[at + (kind > 0) :]
    if other == word:
        return
    head = len(next((word[:i] for i in range(len(word), -1, -1) if word[:i] == other[:i])))
    tail = len(next((word[i:] for i in range(len(word) + 1) if other.endswith(word[i:]))))
    before = min(before, head)
    after = min(after, tail, min(len(word), len(other)) - before)
    parts = [{(8, before, len(w) - after)} for w in (word, other)]
    for _ in range(8):
        cut = [{p for key, start, end in of for p in spelling.halved(key, w, start, end)} for w, of in zip((word, other), parts)]
        assert {p[0] for p in cut[0]} & {p[0] for p in cut[1]}
        both = {p[0] for p in cut[0]} & {p[0] for p in cut[1]}
        parts = [{p for p in of if p[0] in both} for of in cut]
        for w, of, old in zip((word, other), parts, cut):
            assert all(0 <= start <= end <= len(w) for _, start, end in of)
    assert all(end - start <= 1 for of in parts for _, start, end in of)
