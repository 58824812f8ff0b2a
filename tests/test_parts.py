import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_files import NAMES, line

from tallyloom.operators.rates import rate_summary
from tallyloom.plans import parts, report
from tallyloom.sources import commits, files
from tallyloom.sources.publish import forget_old_sets, publish, published, published_sets


def write_day(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([",".join(NAMES), *lines]) + "\n")


def day(n, rows):
    return [line(100 * n + i, int(i % 3 == 0), f"1410{n:02}{i % 24:02}", i % 4, i % 2) for i in range(rows)]


def table(df):
    return sorted((r.chart, r.key, r.clicks, r.impressions, round(r.rate, 9)) for r in df.collect())


def whole(spark, folder):
    return table(report.report(files.read_click_log(spark, str(folder))))


def test_a_new_day_is_added_and_only_it_is_read(spark, tmp_path):
    inbox, kept, store = tmp_path / "in", tmp_path / "kept", str(tmp_path / "store")
    write_day(inbox, "a b%1.csv", day(20, 50))
    write_day(inbox, "x[1].csv", day(21, 40))
    assert parts.count_new_files(spark, str(inbox), store) == 2
    assert parts.count_new_files(spark, str(inbox), store) == 0
    assert table(parts.stored_report(spark, store)) == whole(spark, inbox)
    shutil.copytree(inbox, kept)
    for old in inbox.iterdir():  # a second look at these would fail or find nothing
        old.unlink()
    write_day(inbox, "c.csv", day(22, 30))
    write_day(kept, "c.csv", day(22, 30))
    assert parts.count_new_files(spark, str(inbox), store) == 1
    assert table(parts.stored_report(spark, store)) == whole(spark, kept)


def test_a_changed_file_replaces_what_it_was(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    write_day(inbox, "a.csv", day(20, 50))
    write_day(inbox, "b.csv", day(21, 20))
    parts.count_new_files(spark, str(inbox), store)
    write_day(inbox, "a.csv", day(23, 77))
    assert parts.count_new_files(spark, str(inbox), store) == 1
    assert table(parts.stored_report(spark, store)) == whole(spark, inbox)
    assert parts.counted_files(spark, store).count() == 2


def test_a_run_that_fails_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    write_day(inbox, "a.csv", day(20, 50))
    parts.count_new_files(spark, str(inbox), store)
    before = table(parts.stored_report(spark, store))
    write_day(inbox, "b.csv", day(21, 20))

    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(parts, "add_to_log", stop)
    with pytest.raises(RuntimeError):
        parts.count_new_files(spark, str(inbox), store)
    monkeypatch.undo()
    assert table(parts.stored_report(spark, store)) == before
    assert parts.count_new_files(spark, str(inbox), store) == 1
    assert table(parts.stored_report(spark, store)) == whole(spark, inbox)


def test_a_file_counted_twice_at_a_time_counts_once(spark, tmp_path, monkeypatch):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    write_day(inbox, "a.csv", day(20, 50))
    real = parts.counted_files
    monkeypatch.setattr(parts, "counted_files", lambda s, f: real(s, f).where("false"))
    for _ in range(2):  # neither run sees the other
        parts.count_new_files(spark, str(inbox), store)
    monkeypatch.undo()
    assert spark.read.parquet(f"{store}/{parts.COUNTS}").select("batch").distinct().count() == 2
    assert table(parts.stored_report(spark, store)) == whole(spark, inbox)


def test_other_keys_and_empty_files(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    write_day(inbox, "a.csv", [])
    write_day(inbox, "b.csv", [*day(20, 9), ",,,,,,,,,,,,,,,,,,,,,,,"])
    charts = {"category": "site_category"}
    assert parts.count_new_files(spark, str(inbox), store, ["site_category"]) == 2
    assert parts.count_new_files(spark, str(inbox), store, ["site_category"]) == 0
    got = table(parts.stored_report(spark, store, charts, total=None))
    assert got == table(rate_summary(files.read_click_log(spark, str(inbox)), charts))


def test_the_published_report_follows_the_store(spark, tmp_path):
    inbox, store, out = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "out")
    write_day(inbox, "a.csv", day(20, 50))
    assert parts.bring_up_to_date(spark, str(inbox), store, out) == 1
    assert parts.bring_up_to_date(spark, str(inbox), store, out) == 0
    write_day(inbox, "b.csv", day(21, 60))
    assert parts.bring_up_to_date(spark, str(inbox), store, out) == 1
    assert published_sets(spark, out).count() == 2
    tables = published(spark, out)
    assert set(tables) == {*report.CHARTS, report.TOTAL}
    joined = [(c, r.key, r.clicks, r.impressions, round(r.rate, 9)) for c, t in tables.items() for r in t.collect()]
    assert sorted(joined) == whole(spark, inbox)


# --- sets of tables --------------------------------------------------------------------


def numbers(spark, start, n=3):
    return spark.range(start, start + n)


def test_a_failure_between_two_tables_leaves_the_old_set(spark, tmp_path):
    out = str(tmp_path / "out")
    assert publish(spark, {"a": numbers(spark, 0), "b": numbers(spark, 10)}, out) == 1
    failing = numbers(spark, 20).select(F.when(F.col("id") > 21, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish(spark, {"a": numbers(spark, 5), "b": failing}, out)
    assert published_sets(spark, out).count() == 1
    found = published(spark, out)
    assert {name: min(r.id for r in t.collect()) for name, t in found.items()} == {"a": 0, "b": 10}
    assert publish(spark, {"a": numbers(spark, 5), "b": numbers(spark, 20)}, out) == 2
    assert published(spark, out, "b")["b"].agg(F.min("id")).first()[0] == 20
    assert published(spark, out, "b", number=1)["b"].agg(F.min("id")).first()[0] == 10


def test_readers_keep_the_set_they_began_with(spark, tmp_path):
    out = str(tmp_path / "out")
    publish(spark, {"a": numbers(spark, 0)}, out)
    old = published(spark, out)["a"]
    publish(spark, {"a": numbers(spark, 100)}, out)
    assert old.agg(F.max("id")).first()[0] == 2
    publish(spark, {"a": numbers(spark, 200)}, out)
    forget_old_sets(spark, out, keep=2)
    assert len(list((Path(out) / "sets").iterdir())) == 2
    assert published(spark, out, number=2)["a"].count() == 3
    assert published(spark, out)["a"].agg(F.min("id")).first()[0] == 200
    with pytest.raises(ValueError):
        forget_old_sets(spark, out, keep=0)


def test_two_at_a_time_leave_one_current(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    monkeypatch.setattr(commits, "next_number", lambda log: 1)
    monkeypatch.setattr("tallyloom.sources.publish.next_number", lambda log: 1)
    for start in (0, 10):
        publish(spark, {"a": numbers(spark, start), "b": numbers(spark, start)}, out)
    first = [sorted(r.id for r in t.collect()) for t in published(spark, out).values()]
    assert first[0] == first[1]
    assert [sorted(r.id for r in t.collect()) for t in published(spark, out).values()] == first


def test_nothing_published_is_an_error(spark, tmp_path):
    with pytest.raises(LookupError, match="no set"):
        published(spark, str(tmp_path / "none"))
    publish(spark, {"a": numbers(spark, 0)}, str(tmp_path / "out"))
    with pytest.raises(LookupError, match="no table b"):
        published(spark, str(tmp_path / "out"), "b")
    with pytest.raises(LookupError, match="no set 7"):
        published(spark, str(tmp_path / "out"), number=7)
    with pytest.raises(ValueError):
        publish(spark, {}, str(tmp_path / "out"))
