"""Small tables with everything an operator must stand."""

from pyspark.sql import functions as F

LONG = "The river ran past the old mill and nobody minded. " * 400
TEXTS = [
    (1, "First line of all here\nshort\nA line that repeats again\nlast of one", "en", "b"),
    (2, "  a LINE that repeats again \t\nOnly in two, this one\nshort", "en", "b"),
    (3, "a line that repeats again\na line that repeats again\nÉCOLE est une école\n", "fr", "a"),
    (4, "", "en", "a"),
    (5, None, None, None),
    (6, " \t\n \r\n", "de", "a"),
    (7, "école est une ÉCOLE\nÉCOLE est une école", "fr", "c"),
    (8, LONG, "en", "c"),
    (8, LONG, "en", "c"),
    (9, "same id first text line", None, "c"),
    (9, "same id second text line\nA line that repeats again", None, "c"),
    (None, "no id at all in this row\nA line that repeats again", "en", None),
    (None, None, None, None),
    (10, "x\x00y   z w ퟿ 日本語 テキスト", "ja", "d"),
    (11, "one", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
# Names that operators use themselves.
CLASHING = "id th key hash pos line n g h node size taken epoch score label stats list part rank root".split()


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return df.withColumns({name: F.lit("mine") for name in CLASHING})


def none(df):
    return df.filter("false")


def rows(df, *columns):
    """All rows as sorted tuples, nulls last."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))
