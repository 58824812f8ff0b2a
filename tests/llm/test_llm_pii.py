import itertools
import re

import numpy as np
import pytest
from awkward import documents, none

from tallyloom.llm import pii
from tallyloom.llm.pii import Passage, base_spans, find_personal_data, fit, luhn, personal_data_digest
from tallyloom.sources.tables import table

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def digits(text):
    return re.sub("[^0-9]", "", text)


def by_pattern(text):
    right = (
        lambda s: True,
        lambda s: all(int(p) <= 255 for p in s.split(".")),
        lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)),
        lambda s: 9 <= len(digits(s)) <= 15,
    )
    return [
        (k, m.start(), m.end())
        for k, p in enumerate(PATTERNS)
        for m in re.finditer(p, text, re.ASCII)
        if right[k](m.group())
    ]


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_are_those_of_the_patterns(seed):
    dice = np.random.default_rng(seed)
    letters = list("aZ09@.-+ ()%_é\n4111111111111111") + ["1.2.3.4", "+49 30 1234567", "@x.y", "4111 1111 1111 1111"]
    for _ in range(2000):
        text = "".join(dice.choice(letters, dice.integers(0, 30)))
        assert base_spans(text) == by_pattern(text), text


def test_long_runs_take_no_time():
    assert base_spans("1" * 200_000) == []
    assert base_spans("a" * 100_000 + "@" + "b" * 100_000) == []
    assert base_spans("0" * 6000 + ".1.1.1") == [(1, 0, 6006)]


def test_probabilities_are_those_of_all_segmentations():
    text = "tel 12 34@x 56"
    passage = Passage(text, [(m.start(), m.end()) for m in re.finditer(r"\S+", text)])
    spans = list(passage.spans())
    scores = np.random.default_rng(0).normal(size=(len(spans), len(pii.KINDS)))
    got, log_all = pii._marginals(len(passage.tokens), spans, scores)
    total, share = 0.0, np.zeros_like(scores)
    for size in range(len(passage.tokens) + 1):
        for chosen in itertools.combinations(range(len(spans)), size):
            if any(spans[a][1] > spans[b][0] and spans[b][1] > spans[a][0] for a, b in itertools.combinations(chosen, 2)):
                continue
            for kinds in itertools.product(range(len(pii.KINDS)), repeat=size):
                weight = np.exp(sum(scores[s, k] for s, k in zip(chosen, kinds)))
                total += weight
                for s, k in zip(chosen, kinds):
                    share[s, k] += weight
    assert np.isclose(log_all, np.log(total))
    assert np.allclose(np.exp(got), share / total)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit_field(table(spark, "/root/testdata/sf0.01", "documents"))


@pytest.mark.parametrize(
    "text, span",
    [
        ("write to jane.roe (at) mail.example.com now", "email:9:39"),
        ("the card 4111.1111.1111.1111 was used", "card:9:28"),
        ("4111111111111111 4012888888881881 both", "card:0:16"),
        ("ring 212-555-1234 today", "phone:5:17"),
        ("jane at example.com", "email:0:19"),
        ("write to jane at mail dot a dot co dot uk today", "email:9:41"),
        ("jane.roe at one dot two dot three dot four dot five dot six dot org", "email:0:67"),
        ("call 030 1234567", "phone:5:16"),
        ("tel 0171 555 1234 now", "phone:4:17"),
    ],
)
def test_the_field_adds_spans_the_patterns_miss(field, text, span):
    base, added = pii.all_spans(text, field)
    assert not base
    assert span in pii.written_out(added).split(",")


@pytest.mark.parametrize(
    "text",
    ["ssn 123-45-6789", "his number 123-45-6789 was", "look at example.com", "it is available at www.example.org today",
     "batch 0301 4567", "they dot the i and cross the t", "version 3 of 2.0", "in 2019 there were 1,200 cases", "at 12:30:45 on 2024-03-17", "1234567890123456 things",
     'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "x@y and @name"],
)
def test_the_field_leaves_other_numbers_alone(field, text):
    assert pii.all_spans(text, field) == ([], [])


def test_base_spans_stay(spark, field):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in find_personal_data(docs, field).collect():
        assert r.base == pii.written_out(by_pattern(texts[r.doc_id] or ""))
        assert set(r.base.split(",")) - {""} <= set(r.spans.split(","))


def test_awkward_rows(spark):
    docs = documents(spark)
    got = personal_data_digest(docs).collect()
    assert len(got) == docs.count()
    assert {(r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in got} == {(0, 0, 0, 0, "")}
    assert personal_data_digest(none(docs)).count() == 0
    assert not fit([]).weights.any()


def test_plain_prose_gets_no_spans(field, spark):
    """Every text of the table that no pattern matches, and prose that names sites and numbers."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    plain = [r.text for r in docs if r.text and not base_spans(r.text)]
    wrong = [pii.written_out(pii.all_spans(t, field)[1]) for t in plain]
    assert len(plain) > 50 and sum(map(bool, wrong)) <= len(plain) // 50
