from itertools import combinations

import corpus_pipeline as pipeline
from awkward import documents, none
from test_llm_leaks import leaks_by_hand
from test_llm_lines import by_hand as lines_by_hand
from test_llm_mixing import by_hand as mix_by_hand
from test_llm_simhash import fingerprint, joined

import __spark_entry__ as entry
from tallyloom.llm.shared import written
from tallyloom.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_act(spark):
    docs = table(spark, FOLDER, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, FOLDER))
        assert after.columns == docs.columns, name
        assert after.dtypes == docs.dtypes
        assert 0 < after.count() <= docs.count()
        docs = after
    assert docs.filter("n_chars <> char_length(text)").count() == 0
    assert docs.select("doc_id").distinct().count() == docs.count()
    mix = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert mix.count() > 0
    assert {"epoch", "taken", *docs.columns} == set(mix.columns)


def copies_by_hand(rows):
    """Ids that stay when the fingerprints of every two texts are compared."""
    prints = [fingerprint(text) for _, text in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    label = joined(len(rows), links)
    least = {}
    for (doc_id, _), x in zip(rows, label):
        least[x] = min(doc_id, least.get(x, doc_id))
    return set(least.values())


def test_each_stage_is_what_comparing_everything_gives(spark):
    """Every stage on its own input, after the classifier (whose measure is held-out accuracy)."""
    docs = written(pipeline.keep_good(spark, table(spark, FOLDER, "documents"), FOLDER))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    lined = written(pipeline.drop_lines(spark, docs, FOLDER))
    assert {(r.doc_id, r.text) for r in lined.collect()} == {(i, t) for i, _, _, t in lines_by_hand(rows)}
    for before in (docs, lined):
        kept = written(pipeline.drop_copies(spark, before, FOLDER))
        assert {r.doc_id for r in kept.collect()} == copies_by_hand([(r.doc_id, r.text) for r in before.collect()])
    clean = written(pipeline.drop_leaks(spark, docs, FOLDER))
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").collect()]
    leaky = {d for d, _, _ in leaks_by_hand([(i, t) for i, t, *_ in rows], items)}
    assert {r.doc_id for r in clean.collect()} == {i for i, *_ in rows} - leaky
    taken = {}
    for r in pipeline.mix(spark, docs, FOLDER).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert taken == {i: n for i, _, _, _, n in mix_by_hand(rows) if n}


def test_run_is_what_the_stages_give(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
    got = pipeline.run(spark, FOLDER)
    digest = lambda df: sorted((r.doc_id, r.epoch, r.taken, hash(r.text)) for r in df.collect())
    assert digest(got) == digest(docs)


def test_awkward_rows_pass_all_stages(spark):
    docs = documents(spark)
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER))
        assert docs.columns == documents(spark).columns, name
    assert pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0


def test_empty_documents(spark):
    docs = none(documents(spark))
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
        assert docs.count() == 0


def test_planted_leak_goes(spark):
    item = table(spark, FOLDER, "benchmark").orderBy("item_id").first()
    rows = [(1, f"Some words before. {item.text} And after.", "en", "a"), (2, "Clean words that no item has.", "en", "a")]
    kept = pipeline.drop_leaks(spark, documents(spark, rows), FOLDER)
    assert [r.doc_id for r in kept.collect()] == [2]


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14))
