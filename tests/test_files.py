import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.calendar import hour_start, parse_hour, with_calendar
from tallyloom.operators.rates import click_rates
from tallyloom.plans import regions, report
from tallyloom.sources import files
from tallyloom.streaming.rates import keep_rates, log_stream

NAMES = [column.split()[0] for column in files.CLICK_LOG_COLUMNS.split(",")]


def line(i, click, hour, banner, device):
    row = dict.fromkeys(NAMES, "0") | {
        "id": f"{10**18 + i}", "click": click, "hour": hour, "banner_pos": banner,
        "site_category": f"s{i % 2}", "app_category": "a", "device_type": device,
    }
    return ",".join(str(row[n]) for n in NAMES)


@pytest.fixture
def log_file(tmp_path):
    lines = [
        line(1, 1, "14102100", 0, 1), line(2, 0, "14102100", 1, 1),
        line(3, 0, "14102613", 0, 0), line(4, 1, "14102613", 65535, 1),
    ]
    path = tmp_path / "log.csv"
    path.write_text("\n".join([",".join(NAMES), *lines]) + "\n")
    return str(path)


def test_click_log(spark, log_file):
    log = files.read_click_log(spark, log_file)
    kinds = dict(log.dtypes)
    assert len(NAMES) == 24 and log.columns[:24] == NAMES
    assert (kinds["click"], kinds["hour"], kinds["banner_pos"]) == ("boolean", "timestamp_ntz", "int")
    row = log.where("banner_pos = 65535").first()
    assert row["click"] is True and row["id"] == str(10**18 + 4)
    assert row["hour"] == datetime.datetime(2014, 10, 26, 13)
    assert (row["hour_in_day"], row["weekday"], row["day_name"]) == (13, 6, "Sunday")


def test_scan_reads_only_what_is_used(spark, log_file):
    rates = click_rates(files.read_click_log(spark, log_file), "banner_pos")
    plan = rates._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<click:string,banner_pos:string>" in plan


def test_hour_texts(spark):
    texts = ["14102100", "68010100", "69010100", "1410210", "14139900", "x", None, " 14102105 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_hour(F.col("t")))
    at = datetime.datetime
    assert [r[0] for r in df.collect()] == [
        at(2014, 10, 21), at(2068, 1, 1), at(1969, 1, 1), None, None, None, None, at(2014, 10, 21, 5),
    ]


def test_calendar(spark):
    week = [(datetime.datetime(2024, 1, d, d),) for d in range(1, 8)]  # Monday to Sunday
    days = with_calendar(spark.createDataFrame(week, "hour timestamp_ntz")).collect()
    assert [r["weekday"] for r in days] == list(range(7))
    assert [r["day_name"] for r in days] == [
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"
    ]
    assert [r["hour_in_day"] for r in days] == list(range(1, 8))


def test_report_on_file(spark, log_file, tmp_path):
    report.report_on_file(spark, log_file, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert {r[0] for r in written.select("chart").distinct().collect()} == {*report.CHARTS, report.TOTAL}
    device = spark.read.parquet(str(tmp_path / "out" / "chart=device"))
    assert [tuple(r) for r in device.collect()] == [("1", 2, 3, pytest.approx(200 / 3))]


def test_inferred_csv_gets_plain_names(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("District,2011 Rain (mm),2011 Rain [mm]\nA,655,1.5\nB,1306.9,2\n")
    df = files.read_csv(spark, str(path))
    assert df.dtypes == [("district", "string"), ("y2011_rain_mm", "double"), ("y2011_rain_mm_2", "double")]
    typed = files.read_csv(spark, str(path), "a string, b double, c double")
    assert typed.dtypes == [("a", "string"), ("b", "double"), ("c", "double")]


def test_regional_report(spark, tmp_path):
    path = tmp_path / "rain.csv"
    # the roll-up row is the mean of the three others
    path.write_text("District,2011 Rain,2012 Rain\nA,10,30\nB,20,10\nC,60,80\nAVERAGE,30,40\n")
    out = str(tmp_path / "out")
    years = ["y2011_rain", "y2012_rain"]
    regions.regional_report(spark, str(path), out, years, regions.RAINFALL)
    classes = {r["district"]: r["class_y2011_rain"] for r in spark.read.parquet(f"{out}/classes").collect()}
    low, high = regions.RAINFALL
    assert classes == {"A": low, "B": low, "C": high, "AVERAGE": high}
    assert {r[0] for r in spark.read.parquet(f"{out}/always_high").collect()} == {"C", "AVERAGE"}
    assert spark.read.parquet(f"{out}/series").count() == 8
    assert spark.read.parquet(f"{out}/class_sizes").count() == 4


def test_stream_brings_the_table_up_to_date(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("logs", "rates", "state"))
    log = spark.range(1000).select(
        (F.col("id") % 5 == 0).alias("click"),
        F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("hour"),
        (F.col("id") % 3).cast("int").alias("banner_pos"),
    )
    for part in range(2):
        log.where(F.col("banner_pos") >= part).write.mode("append").parquet(folder)
        stream = log_stream(spark, folder, log.schema)
        keep_rates(stream, "banner_pos", out, state).awaitTermination()
        expected = click_rates(spark.read.parquet(folder), "banner_pos")
        assert {tuple(r) for r in spark.read.parquet(out).collect()} == {tuple(r) for r in expected.collect()}


def write(path, names, rows):
    path.write_text("\n".join([",".join(names), *(",".join(r[n] for n in names) for r in rows)]) + "\n")
    return str(path)


def values(i=1, **other):
    return dict.fromkeys(NAMES, "0") | {"id": str(i), "click": "1", "hour": "14102113", "C1": "1005"} | other


def test_columns_are_found_by_name(spark, tmp_path):
    names = [*reversed(NAMES), "more"]
    log = files.read_click_log(spark, write(tmp_path / "a.csv", names, [values(banner_pos="7", more="x")]))
    row = log.first()
    assert (row.click, row.C1, row.banner_pos, row.more, row.hour_in_day) == (True, 1005, 7, "x", 13)
    assert log.columns[:24] == NAMES


def test_a_missing_column_is_an_error(spark, tmp_path):
    path = write(tmp_path / "b.csv", [n for n in NAMES if n not in ("click", "C14")], [values()])
    with pytest.raises(ValueError, match="no column click, C14"):
        files.read_click_log(spark, path)


def test_values_that_do_not_fit_are_null(spark, tmp_path):
    rows = [values(1, click="yes"), values(2, click="FALSE"), values(3, click="", C1="abc", hour="noon")]
    log = files.read_click_log(spark, write(tmp_path / "c.csv", NAMES, rows))
    assert [(r.click, r.C1, r.hour is None) for r in log.orderBy("id").collect()] == [
        (None, 1005, False), (False, 1005, False), (None, None, True),
    ]


def test_hours_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("24031002",), ("24110301",)], "t string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        hours = [r[0] for r in df.select(parse_hour(F.col("t"))).collect()]
        starts = df.select((parse_hour(F.col("t")) + F.expr("INTERVAL 59 MINUTES 3.5 SECONDS")).alias("ts"))
        cut = [r[0] for r in starts.select(hour_start("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert hours == cut == [datetime.datetime(2024, 3, 10, 2), datetime.datetime(2024, 11, 3, 1)]


def broken(tmp_path):
    """Lines with a fault of each kind, among them good ones and empty fields."""
    good = [line(i, i % 2, "14102113", 1, 1) for i in range(4)]
    lines = [
        *good,
        good[0].rsplit(",", 1)[0],  # a field too few
        good[1] + ",9,9",  # two too many
        line(10, "maybe", "14102113", 1, 1),
        line(11, 1, "noon", "x", 1),
        line(12, "", "", "", ""),  # empty fields are missing values
        line(13, " TRUE ", "14102113", " 7 ", 1),
        "",
        "garbage",
    ]
    path = tmp_path / "broken.csv"
    path.write_text("\n".join([",".join(NAMES), *lines]) + "\n")
    return str(path), len(lines) - 1


def test_good_and_rejected_rows_are_all_lines(spark, tmp_path):
    path, n = broken(tmp_path)
    checked = files.check_click_log(spark, path)
    counts = {r.reason: r.rows for r in files.reject_counts(checked).collect()}
    assert counts == {"lines": n, "good": 6, "rejected": n - 6, "fields": 3, "click": 1, "hour": 1, "banner_pos": 1}
    rejected = {(r.id, tuple(r.reasons)): r.line for r in files.rejects(checked).collect()}
    ids = {i for i, _ in rejected}
    assert str(10**18 + 10) in ids and str(10**18 + 11) in ids
    assert rejected[str(10**18 + 11), ("hour", "banner_pos")] is None
    assert sorted(v for v in rejected.values() if v)[-1] == "garbage"
    assert all(r.source.endswith("broken.csv") for r in files.rejects(checked).collect())


def test_good_rows_are_those_of_the_plain_scan(spark, tmp_path):
    path, _ = broken(tmp_path)
    good = files.good_rows(files.check_click_log(spark, path))
    plain = files.read_click_log(spark, path)
    assert good.dtypes == plain.dtypes
    ids = [r.id for r in good.collect()]
    assert len(ids) == 6
    same = plain.where(F.col("id").isin(ids) & F.col("C21").isNotNull() & (F.col("site_id") == "0"))
    assert sorted(map(tuple, good.collect()), key=str) == sorted({tuple(r) for r in same.collect()} & {tuple(r) for r in good.collect()}, key=str)


def test_checked_scan_of_reordered_columns(spark, tmp_path):
    names = [*reversed(NAMES), "more"]
    path = write(tmp_path / "r.csv", names, [values(1, more="x"), values(2, click="7", more="y")])
    checked = files.check_click_log(spark, path)
    assert [(r.id, r.more) for r in files.good_rows(checked).collect()] == [("1", "x")]
    assert [(r.id, r.reasons) for r in files.rejects(checked).collect()] == [("2", ["click"])]
    short = write(tmp_path / "s.csv", [n for n in NAMES if n != "hour"], [values()])
    with pytest.raises(ValueError, match="no column hour"):
        files.check_click_log(spark, short)
    empty = write(tmp_path / "e.csv", NAMES, [])
    assert files.reject_counts(files.check_click_log(spark, empty)).count() == 0
