"""CSV scans and table sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.calendar import parse_hour, with_calendar

# Columns of the click log with their types, in file order. Codes are 16-bit
# unsigned there; a 32-bit integer holds all of them. Click (0/1, which the CSV reader does
# not take for a boolean) and hour are read as text and typed afterwards.
CLICK_LOG_COLUMNS = """
    id string, click string, hour string, C1 int, banner_pos int,
    site_id string, site_domain string, site_category string,
    app_id string, app_domain string, app_category string,
    device_id string, device_ip string, device_model string,
    device_type int, device_conn_type int,
    C14 int, C15 int, C16 int, C17 int, C18 int, C19 int, C20 int, C21 int
"""


# Names that a checked scan adds to its rows.
REASONS, LINE, SOURCE = "_reasons", "_line", "_source"
#: The reason of a line with too few or too many fields.
FIELD_COUNT = "fields"


def _kinds() -> dict[str, str]:
    return dict(column.split() for column in CLICK_LOG_COLUMNS.split(","))


def _typed(name: str, kind: str) -> Column:
    """The text of a column as its type; null if it does not fit."""
    if name == "click":
        said = F.lower(F.trim("click"))
        return F.when(said.isin("1", "true"), True).when(said.isin("0", "false"), False)
    if name == "hour":
        return parse_hour(F.col("hour"))
    return F.col(name) if kind == "string" else F.col(name).try_cast(kind)


def _need_columns(path: str | Sequence[str], found: Sequence[str]) -> None:
    missing = [name for name in _kinds() if name not in found]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")


def read_click_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Typed scan of a click log in CSV, its hour parsed and calendar columns added.

    Columns are found by the names in the header, in whatever order they stand there; all
    files of a log must have the same header. A missing column raises an error, further ones
    follow as text. Values that do not fit their column are null: a click other than 0, 1,
    true or false, an hour that is none, a code that is no number. No pass over the file is
    spent on guessing types. :func:`check_click_log` tells which lines were not read as they
    stand.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    _need_columns(path, raw.columns)
    columns = [_typed(name, kind).alias(name) for name, kind in _kinds().items()]
    return with_calendar(raw.select(*columns, *(c for c in raw.columns if c not in _kinds())))


def check_click_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The rows of :func:`read_click_log`, one per line, with what is wrong with them.

    Added columns: ``_reasons``, the names of the columns whose text does not fit them
    (an empty field is no fault) and ``fields`` for a line with too few or too many fields;
    ``_line``, the text of such a line; ``_source``, the file. Every line after a header gives
    one row, so good and rejected rows are all lines; blank lines are none. Files are read once,
    whole, as the number of fields is seen in whole lines only.
    """
    header = spark.read.option("header", True).csv(path).columns
    _need_columns(path, header)
    schema = ", ".join(f"`{name}` string" for name in [*header, LINE])
    raw = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        .option("columnNameOfCorruptRecord", LINE).option("columnPruning", False).csv(path)
    )
    reasons = [F.when(F.col(LINE).isNotNull(), FIELD_COUNT)]
    for name, kind in _kinds().items():
        if kind != "string" or name in ("click", "hour"):
            filled = F.trim(name) != ""
            reasons.append(F.when(filled & _typed(name, kind).isNull(), name))
    columns = [_typed(name, kind).alias(name) for name, kind in _kinds().items()]
    others = [c for c in header if c not in _kinds()]
    rows = raw.select(
        *columns, *others, F.array_compact(F.array(*reasons)).alias(REASONS), LINE, F.input_file_name().alias(SOURCE)
    )
    return with_calendar(rows)


def good_rows(checked: DataFrame) -> DataFrame:
    """Rows of a checked log that were read as they stand."""
    return checked.where(F.size(REASONS) == 0).drop(REASONS, LINE, SOURCE)


def rejects(checked: DataFrame) -> DataFrame:
    """The other rows: ``source``, ``id``, ``reasons`` and, of lines with a wrong number of
    fields, the ``line``."""
    rows = checked.where(F.size(REASONS) > 0)
    return rows.select(F.col(SOURCE).alias("source"), "id", F.col(REASONS).alias("reasons"), F.col(LINE).alias("line"))


def reject_counts(checked: DataFrame) -> DataFrame:
    """``reason`` and ``rows``, from one scan: ``lines`` for all lines, ``good`` for those read as they
    stand, ``rejected`` for the others, and each reason for the rows it is a reason of."""
    good = F.size(REASONS) == 0
    entries = F.concat(
        F.array(F.lit("lines"), F.when(good, "good").otherwise("rejected")), F.transform(REASONS, lambda r: r)
    )
    return checked.select(F.explode(entries).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Scan of any CSV with a header; types are inferred unless given, names made plain."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return with_plain_names(reader.csv(path))


def plain_name(text: str) -> str:
    """``2004 to 2005 (In Rupees)`` to ``y2004_to_2005_in_rupees``."""
    name = re.sub(r"[^0-9a-z]+", "_", text.lower()).strip("_")
    return f"y{name}" if name[:1].isdigit() else name or "column"


def with_plain_names(df: DataFrame) -> DataFrame:
    """Rename all columns to snake case; equal results get a running number."""
    names: list[str] = []
    for column in df.columns:
        name = base = plain_name(column)
        count = 1
        while name in names:
            count += 1
            name = f"{base}_{count}"
        names.append(name)
    return df.toDF(*names)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace the table at ``path``, one folder per value of ``partition_by``."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
