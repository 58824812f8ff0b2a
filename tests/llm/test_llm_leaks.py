import random
from collections import defaultdict

import pytest
import regex
from awkward import documents, none
from pyspark.sql import functions as F

from tallyloom.llm import leaks
from tallyloom.llm.leaks import MIN_WINDOWS, UNITS, WINDOW, leak_report, without_leaks
from tallyloom.sources.tables import table

ITEM = (
    "A train leaves Paris at noon and travels 120 km in 3 hours while Alice walks 5 km from her "
    "house to the station, so how fast is the train when Alice arrives at the station of Paris?"
)
OTHER = (
    "A train leaves Lyon at noon and travels 200 km in 4 hours while Bob walks 7 km from her "
    "house to the station, so how fast is the train when Bob arrives at the station of Lyon?"
)
MIXED = (
    "A train leaves Lyon at noon and travels 200 km in 4 hours while Bob walks 7 km from her "
    "house to the station, so how fast is the train when Carol arrives at the station of Rome?"
)
PROSE = "The trains of this country leave on time, and many people walk from their house to a station. "


def bench(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    return df.withColumn("id", F.lit("mine"))


def leaky(spark, texts, items):
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    return {(r.doc_id, r.item_id) for r in leak_report(docs, bench(spark, *items)).collect()}


def test_exact_and_reparametrised_questions_are_found(spark):
    texts = [PROSE * 3 + ITEM + " " + PROSE, PROSE + OTHER, PROSE * 5, ITEM.upper(), None, ""]
    assert {(0, 0), (1, 0)} <= leaky(spark, texts, [ITEM, PROSE.upper() + "zzz"])
    assert not {d for d, i in leaky(spark, texts, [ITEM]) if d in (2, 4, 5)}


def test_slots_that_do_not_agree_void_the_passage(spark):
    assert leaky(spark, [OTHER], [ITEM]) == {(0, 0)}
    assert leaky(spark, [MIXED], [ITEM]) == set()


def test_changed_words_leave_enough_windows(spark):
    words = PROSE.split() * 3
    words[3] = "otherwise"
    item = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    edited = item.split()
    edited[30] = "changed"
    assert leaky(spark, [" ".join(edited), " ".join(words)], [item]) == {(0, 0)}


def test_short_items_are_found_whole(spark):
    texts = ["before that came Who wrote the Iliad then and there after", "who wrote it then", ""]
    assert leaky(spark, texts, ["wrote the Iliad then", "", "..."]) == {(0, 0)}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    texts = [PROSE + ITEM, PROSE + OTHER, PROSE]
    first = leaky(spark, texts, [ITEM, OTHER])
    monkeypatch.setattr(leaks, "BROADCAST_HASHES", 0)
    assert leaky(spark, texts, [ITEM, OTHER]) == first


def test_awkward_rows(spark):
    docs = documents(spark)
    items = bench(spark, None, "", docs.filter("doc_id = 8").first().text[:400])
    assert {r.doc_id for r in leak_report(docs, items).collect()} == {8}
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 2
    assert leak_report(none(docs), items).count() == 0
    assert leak_report(docs, none(items)).count() == 0
    assert without_leaks(docs, none(items)).count() == docs.count()


@pytest.mark.parametrize(
    "text, plain, named",
    [
        ("It costs 1,000.50 USD or 5kg of Gold.", "it costs 0 U or 0 U of gold", "N costs 0 U or 0 U of N"),
        ("He met Anna. Then Anna left.", "he met anna then anna left", "N met N N N left"),
        ("km 5 km NASA", "km 0 U nasa", "km 0 U nasa"),
    ],
)
def test_templates(spark, text, plain, named):
    marked = leaks.marked(F.lit(text))
    row = spark.range(1).select(leaks.template(marked), leaks.named_template(marked)).first()
    assert tuple(row) == (plain, named)


def tokens_by_hand(text):
    """(token, kind) of every token: N capitalised, 0 a number, U a unit, w another word."""
    text = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text or "")
    text = regex.sub(r"(?<=[0-9])(?=\p{L})", " ", text)
    found = []
    for word in regex.findall(r"[\p{L}\p{M}\p{N}]+", text):
        kind = "w"
        if regex.match(r"\p{Lu}\p{Ll}", word):
            kind = "N"
        elif regex.fullmatch("[0-9]+", word):
            kind = "0"
        elif word.lower() in UNITS and found and found[-1][1] == "0":
            kind = "U"
        found.append((word.lower(), kind))
    return found


def forms_by_hand(window):
    """All a window may be found by: its form, its form with names, or its own words."""
    least = min(3, len(window))
    form = tuple(k if k in "0U" else w for w, k in window)
    names = tuple(w if k == "w" else k for w, k in window)
    rich = lambda f: sum(x not in ("N", "0", "U") for x in f) >= least
    found = {("form", form) if rich(form) else ("own", tuple(w for w, _ in window))}
    return found | ({("names", names)} if "N" in names and rich(names) else set())


def leaks_by_hand(docs, items):
    """(doc_id, item_id, windows) by comparing every window of every document."""
    cut, by_window, n_windows = {i: tokens_by_hand(t) for i, t in items}, defaultdict(list), {}
    for i, row in cut.items():
        width = min(WINDOW, len(row))
        n_windows[i] = len(row) - width + 1 if row else 0
        for p in range(n_windows[i]):
            for form in forms_by_hand(row[p : p + width]):
                by_window[form].append((i, p, width))
    widths = {w for found in by_window.values() for _, _, w in found}
    found = set()
    for d, text in docs:
        row, lines = tokens_by_hand(text), defaultdict(set)
        for width in widths:
            for p in range(len(row) - width + 1):
                for form in forms_by_hand(row[p : p + width]):
                    for i, q, _ in by_window.get(form, ()):
                        lines[i, p - q].add((q, width))
        good = defaultdict(set)
        for (i, line), places in lines.items():
            pairs = {
                (cut[i][q + k][0], row[q + line + k][0])
                for q, width in places
                for k in range(width)
                if cut[i][q + k][1] != "w"
            }
            if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                good[i] |= {q for q, _ in places}
        found |= {(d, i, len(q)) for i, q in good.items() if len(q) >= min(MIN_WINDOWS, n_windows[i])}
    return found


def test_same_as_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    extra = [(100_000 + i, t, None, None, 0) for i, t in enumerate((ITEM, OTHER, MIXED, PROSE + ITEM, PROSE))]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    items = items.unionByName(spark.createDataFrame([(9_000, ITEM), (9_001, "wrote the Iliad then")], items.schema))
    got = {(r.doc_id, r.item_id, r.n_windows) for r in leak_report(docs, items).collect()}
    wanted = leaks_by_hand([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert got == wanted
    assert {d for d, i, _ in got if i == 9_000} == {100_000, 100_001, 100_003}
    assert len(got) > 3


def test_one_contradiction_leaves_the_rest_of_a_copy(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    number = lambda a, b: " ".join([*words[:30], a, *words[31:70], b, *words[71:]])
    assert leaky(spark, [number("5", "6"), number("4", "4")], [number("5", "5"), number("3", "5")]) == {
        (d, i) for d in (0, 1) for i in (0, 1)
    }
    edited = ITEM.replace("5 km", "120 miles")
    assert leaky(spark, [edited, MIXED], [ITEM]) == {(0, 0)}


def test_tables_of_other_numbers_are_no_leaks(spark):
    """One item of thirty numbers, twenty tables of two thousand others, and one that copies a row."""
    dice = random.Random(7)
    item = "Sort: " + " ".join(str(dice.randrange(10, 10_000)) for _ in range(30))
    tables = [" ".join(str(dice.randrange(10, 10_000)) for _ in range(2000)) for _ in range(20)]
    copied = " ".join([*tables[0].split()[:100], *item.split()[1:], *tables[1].split()[:100]])
    assert leaky(spark, [*tables, copied], [item]) == {(20, 0)}
    names = "Anna Bert Carl Dora Emil Fritz Gerd Hans Ida Jens Karl Lena Mia Nina Otto Paul"
    other = "Zoe Yan Xaver Willi Vera Udo Tim Sven Rolf Queen Petra Olaf Nele Mark Lars Kim"
    assert leaky(spark, [other, names], [names]) == {(1, 0)}


def test_number_tables_meet_few_windows(spark):
    dice = random.Random(8)
    text = lambda n: " ".join(str(dice.randrange(10, 10_000)) for _ in range(n))
    docs = documents(spark, [(i, text(2000), "en", "a") for i in range(5)])
    rows = leaks._all_windows(leaks._tokenised(docs, "doc_id", "text"), [WINDOW])
    items = leaks._all_windows(leaks._tokenised(bench(spark, text(30)), "item_id", "text"), [WINDOW])
    assert rows.count() == 5 * 1993
    assert rows.join(items.select("hash"), "hash").count() == 0


def test_a_name_at_the_head_of_each_sentence(spark):
    item = " ".join(f"Tom {w} three old red boats down the river." for w in ("rows", "pulls", "carries", "sells"))
    texts = [item.replace("Tom", "Ann"), PROSE + item.replace("Tom", "Ann").replace("three", "three"), item.lower(), item.upper(), PROSE]
    assert leaky(spark, texts, [item]) == {(d, 0) for d in range(4)}
    # Two names for one are another text; nothing else is left of the passage but short ends.
    mixed = item.replace("Tom", "Ann", 2).replace("Tom", "Joe")
    assert leaky(spark, [mixed.replace("old", "new")], [item]) == set()


def test_a_common_passage_of_many_items_and_documents(spark):
    """Every document meets every item, but only in a window or two: no pair is left."""
    common = "this text is given to you under the usual terms"
    items = [f"{common} " + " ".join(f"{chr(97 + i)}{chr(97 + j)}x" for j in range(20)) for i in range(20)]
    texts = [f"{common} " + " ".join(f"{chr(97 + i)}{chr(97 + j)}y" for j in range(20)) for i in range(20)]
    assert leaky(spark, texts, items) == set()


def test_positions_are_rows_before_their_windows_are_hashed(spark):
    """Functions over arrays are not compiled, so no window is hashed inside one; all windows are there."""
    words = " ".join(f"word{i}" for i in range(20))
    rows = spark.createDataFrame([(1, words), (2, "Anna " + words), (3, "1 2 3 4 5 6 7 8 two words"), (4, "short")], "doc_id long, text string")
    found = leaks._all_windows(leaks._tokenised(rows, "doc_id", "text"), [leaks.WINDOW])
    assert "explode(sequence(" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["id"], r["form"], r["pos"]) for r in found.select(F.col("id"), "form", "pos").collect())
    ids = [r["id"] for r in leaks._tokenised(rows, "doc_id", "text").collect()]
    wanted = [(ids[0], 0, i) for i in range(13)] + [(ids[1], 0, i) for i in range(14)] + [(ids[1], 1, 0)] + [(ids[2], 0, i) for i in range(3)]
    assert got == sorted(wanted)
    same = found.where("id = 1 AND pos = 0").join(found.where("id = 2 AND pos = 1 AND form = 0").select("hash"), "hash")
    assert same.count() == 1
