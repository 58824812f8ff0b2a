"""Benchmark decontamination by templates.

A text becomes a row of tokens: lower-cased words, and typed placeholders for numbers, units
and names. Windows of templates are joined by hash, so a question whose numbers or names were
exchanged still meets its original. What fills the slots must then agree: one value of the
item stands for one value of the document along the passage, and the other way round.

Every capitalised word may be a name or the first of a sentence, so windows are read in two
forms: with such words as they are (which finds copies in any case), and with a placeholder for
each. Windows of hardly more than placeholders prove nothing by their form; they count only with
the very values of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import known_id, text_hash, whole_text, written

WINDOW = 8
#: Windows in line that make a passage: 5 windows of 8 are 12 tokens.
MIN_WINDOWS = 5
#: Words that a window has at least beside placeholders, to be found by its form.
LITERALS = 3
#: Window hashes, and names of documents with a hit, are broadcast up to this many (16 bytes
#: each); beyond it the joins shuffle.
BROADCAST_HASHES = 1_000_000

# Units of measure that may follow a number.
UNITS = (
    "mm cm m km inch inches ft feet yd yards mi mile miles mg g kg t lb lbs oz ml l liter liters "
    "litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years percent pct dollar dollars usd eur euro euros gbp pound pounds cent cents "
    "c f k pa kpa bar v kv a ma w kw mw j kj cal kcal hz khz mhz ghz b kb mb gb tb"
).split()
NAME_MARK = "\u0001"
ID, TEXT_HASH = "_leak_id", "_leak_th"


def marked(text: Column) -> Column:
    """The text as tokens with one blank between them, case kept, and a mark before each word of a
    capital and a small letter.

    A number keeps its digits only (1,000.5 is 10005), and letters that follow it are a token
    of their own.
    """
    text = F.replace(text, F.lit(NAME_MARK), F.lit(" "))
    # Most texts have no digit: two passes less for them.
    plain = F.regexp_replace(text, r"([0-9])[.,](?=[0-9])", "$1")
    plain = F.regexp_replace(plain, r"([0-9])(?=\p{L})", "$1 ")
    text = F.when(text.rlike("[0-9]"), plain).otherwise(text)
    # Looks back only where a capital and a small letter follow.
    text = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}\p{N}])", NAME_MARK)
    return F.btrim(F.regexp_replace(text, rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME_MARK}]+", " "))


def words_only(marked_text: Column) -> Column:
    """The tokens in lower case, without marks."""
    return F.replace(F.lower(marked_text), F.lit(NAME_MARK), F.lit(""))


def _numbers(text: Column) -> Column:
    """Placeholders 0 (number) and U (unit after a number) in place of tokens."""
    number = F.regexp_replace(text, r"(?<!\S)[0-9]+(?!\S)", "0")
    number = F.regexp_replace(number, rf"(?<=(?<!\S)0 )(?:{'|'.join(UNITS)})(?!\S)", "U")
    return F.when(text.rlike("[0-9]"), number).otherwise(text)


def _numbers(text: Column) -> Column:
    """Placeholders 0 (number) and U (unit after a number) in place of tokens."""
    number = F.regexp_replace(text, r"(?<!\S)[0-9]+(?!\S)", "0")
    number = F.regexp_replace(number, rf"(?<=(?<!\S)0 )(?:{'|'.join(UNITS)})(?!\S)", "U")
    return F.when(text.rlike("[0-9]"), number).otherwise(text)


def template(marked_text: Column) -> Column:
    """Placeholders for numbers and units, names as they are."""
    return F.replace(_numbers(F.lower(marked_text)), F.lit(NAME_MARK), F.lit(""))


def named_template(marked_text: Column) -> Column:
    """Placeholders for numbers and units, and N for each marked word."""
    return F.regexp_replace(_numbers(F.lower(marked_text)), rf"{NAME_MARK}\S+", "N")


def tokens(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def kinds(row: Column) -> Column:
    """What each token of a text with marks and placeholders for numbers is: 0, U, N (marked) or w."""
    kind = lambda t: F.when(F.startswith(t, F.lit(NAME_MARK)), "N").when(t.isin("0", "U"), t).otherwise("w")
    return F.transform(row, kind)


# Six placeholders in a window of eight have two words between them at most.
_CROWD = "(?:w{0,2}[0U%s]){6}"


#: What a token counts in a window's sum: words in the low half, names in the high half.
_WORD, _NAME = 1, 1 << 16


def _window_at(widths: list[int]) -> tuple[Column, Column]:
    """The hash of the window at ``pos`` of a row of :func:`_all_windows`, and whether it counts.

    Form 0 is the template without names; where that has fewer than ``LITERALS`` words, the tokens
    themselves (``exact``) take its place. Form 1 is the template with names, of windows with a name
    and enough words.
    """
    # Single places: a slice copies the whole array, for every window of a long text.
    at = lambda column, width: [F.get(column, F.col("pos") + j) for j in range(width)]
    value, counts = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    for n in widths:
        here = F.col("width") == n
        value = F.when(here, F.xxhash64("seed", *at("hashes", n))).otherwise(value)
        counts = F.when(here, sum(at("counts", n)[1:], at("counts", n)[0])).otherwise(counts)
    n_words, n_names = counts.bitwiseAND(_NAME - 1), F.shiftright(counts, 16)
    least = F.least(F.lit(LITERALS), F.col("width"))
    own = ((n_words + n_names) < least) == F.col("exact")
    with_name = (n_names > 0) & (~F.col("named_thin") | (n_words >= least))
    return value, F.when(F.col("form") == 1, with_name).otherwise(~F.col("thin") | own)


def _tokenised(df: DataFrame, id_: str, text: str) -> DataFrame:
    text_column = marked(whole_text(text))
    return df.select(
        known_id(id_).alias("id"), text_hash(text).alias("th"), text_column.alias("marked")
    )


def _all_windows(df: DataFrame, widths: list[int]) -> DataFrame:
    """One row per window and form: id, th, width, pos, hash, form.

    Tokens are hashed once each, and windows of hashes are hashed: for the template without names
    (``plain``), that with names (``named``), and the tokens as they are (``words``, only where
    windows may lack other words).
    """
    base = _numbers(F.lower(F.col("marked")))
    cut = df.select("id", "th", "marked", tokens(base).alias("row"))
    cut = cut.withColumns({"kinds": kinds(F.col("row")), "names": F.instr("marked", NAME_MARK) > 0})
    mark = F.lit(NAME_MARK)
    bare = lambda t: F.when(F.startswith(t, mark), F.substr(t, F.lit(2))).otherwise(t)
    plain = F.transform("row", lambda t: F.xxhash64(bare(t)))
    named = F.transform("row", lambda t: F.when(F.startswith(t, mark), F.xxhash64(F.lit("N"))).otherwise(F.xxhash64(t)))
    letters = F.array_join("kinds", "")
    crowded = letters.rlike(_CROWD.replace("w", "[wN]") % "")
    words = F.transform(tokens(words_only(F.col("marked"))), lambda t: F.xxhash64(t))
    none = F.array().cast("array<bigint>")
    code = lambda k: F.when(k == "w", _WORD).when(k == "N", _NAME).otherwise(0)
    row = F.struct(
        F.size("row").alias("n"), plain.alias("plain"), F.when(F.col("names"), named).otherwise(none).alias("named"),
        F.when(F.lit(len(widths) > 1) | crowded, words).otherwise(none).alias("words"),
        F.transform("kinds", code).alias("counts"),
        crowded.alias("crowded"), letters.rlike(_CROWD % "N").alias("names_crowded"),
        F.col("names").alias("has_names"),
    )
    # Positions become rows before their windows are hashed: functions over arrays are not compiled.
    # Windows are looked at one by one only where some may lack words.
    rows = cut.select("id", "th", F.inline(F.array(row)))

    def entry(n: int, form: int, hashes: str, exact: bool = False) -> Column:
        thin = F.lit(n < WINDOW) | F.col("crowded")
        fields = {
            "width": F.lit(n), "form": F.lit(form), "seed": F.lit(-n if exact else n), "exact": F.lit(exact),
            "hashes": F.col(hashes), "thin": thin, "named_thin": F.lit(n < WINDOW) | F.col("names_crowded"),
        }
        wanted = thin if exact else F.col("has_names") if form else F.lit(True)
        return F.when(wanted & (F.col("n") >= n), F.struct(*[v.alias(k) for k, v in fields.items()]))

    kinds_of = [entry(n, *how) for n in widths for how in ((0, "plain"), (0, "words", True), (1, "named"))]
    rows = rows.select("id", "th", "n", "counts", F.inline(F.array_compact(F.array(*kinds_of))))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("pos"))
    value, there = _window_at(widths)
    return rows.filter(there).select("id", "th", "width", "pos", value.alias("hash"), "form")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    min_windows: int = MIN_WINDOWS,
) -> DataFrame:
    """Documents that hold a passage of a benchmark item, one row per document and item.

    Columns: ``doc_id``, ``item_id``, ``n_windows`` (different windows of the item found, with
    agreeing slots), ``n_item_windows``, ``item_share``, and the working columns ``_leak_id``
    and ``_leak_th`` that name the row. A pair counts from ``min_windows`` windows on, or when
    all windows of a shorter item are found. Items of fewer than ``width`` tokens have one
    window, the whole item, which is looked for at its own width; an item without a token
    leaks nowhere. A window of fewer than ``LITERALS`` words beside its placeholders is found
    only with the item's own tokens. Slots are compared along each run of windows in line: they
    share a map from the item's values to the document's. A value with two partners voids the
    windows that hold it, unless their slots are those of the item. Where such windows are half of
    the run or more it is another question in the same form: there only passages of twice
    ``WINDOW`` tokens or more with the very slots of the item count.

    Null ids count as one id after all others, repeated ids with different texts are told
    apart by the text, null texts are empty, further columns are not read. Empty tables give
    no rows. Nothing is cut: a document of any length gives all its windows.

    The benchmark's window hashes are counted first: as many as ``BROADCAST_HASHES`` go to
    every executor, and document windows that match none never leave their task. Beyond that
    the same join shuffles. Pairs of a document and an item are counted before any token is
    looked at again; those with too few windows go.
    """
    items = written(_tokenised(benchmark, "item_id", "text"))
    length = F.size(tokens(words_only(F.col("marked"))))
    lengths = items.filter((length > 0) & (length < width)).select(length.alias("n")).distinct()
    widths = [width, *sorted(r.n for r in lengths.collect())]
    # An item is looked for at one width: the given one, or its own if it is shorter.
    item_windows = written(
        _all_windows(items, widths)
        .join(items.select("id", "th", length.alias("n")).distinct(), ["id", "th"])
        .filter(F.col("width") == F.least(F.lit(width), F.col("n")))
        .distinct()
    )
    hashes, of_items = item_windows.select("hash").distinct(), item_windows
    if item_windows.count() <= BROADCAST_HASHES:
        hashes, of_items = F.broadcast(hashes), F.broadcast(of_items)
    texts = _tokenised(docs, "doc_id", "text")
    found = written(_all_windows(texts, widths).join(hashes, "hash").distinct())

    key = ["id", "th", "item_id", "item_th"]
    of_items = of_items.select(
        "hash", "form", F.col("id").alias("item_id"), F.col("th").alias("item_th"), F.col("pos").alias("item_pos")
    )
    met = written(found.join(of_items, ["hash", "form"]))
    counts = item_windows.groupBy(F.col("id").alias("item_id"), F.col("th").alias("item_th")).agg(
        F.count_distinct("pos").alias("n_item_windows")
    )
    least = F.least(F.lit(min_windows), F.col("n_item_windows"))
    enough = (
        met.groupBy(*key).agg(F.count_distinct("item_pos").alias("n"))
        .join(counts, ["item_id", "item_th"]).filter(F.col("n") >= least).select(*key)
    )
    line = F.col("pos") - F.col("item_pos")
    # A window found in both forms counts as it is.
    met = (
        met.join(enough, key, "left_semi").groupBy(*key, "pos", "item_pos", "width")
        .agg(F.min("form").alias("form")).withColumn("line", line)
    )
    good = _agreeing(written(_with_slots(written(met), docs, items)), key)
    pairs = (
        good.groupBy(*key)
        .agg(F.count_distinct("item_pos").alias("n_windows"))
        .join(counts, ["item_id", "item_th"])
        .filter(F.col("n_windows") >= least)
    )
    return pairs.select(
        F.col("id").alias("doc_id"),
        "item_id",
        "n_windows",
        "n_item_windows",
        (F.col("n_windows") / F.col("n_item_windows")).alias("item_share"),
        F.col("id").alias(ID),
        F.col("th").alias(TEXT_HASH),
    )


def _agreeing(met: DataFrame, key: list[str]) -> DataFrame:
    """The windows of ``met`` whose slots agree along their run."""
    in_line = Window.partitionBy(*key, "line").orderBy("pos")
    runs = written(met.withColumn("run", F.col("pos") - F.row_number().over(in_line)))
    run = [*key, "line", "run"]
    values = runs.select(*run, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    partners = values.select(*run, F.col("s.item_slots").alias("there"), F.col("s.slots").alias("here")).distinct()

    def with_two(side: str) -> DataFrame:
        return partners.groupBy(*run, side).agg(F.count("*").alias("n")).filter("n > 1").select(*run, side)

    odd = (
        with_two("there").unionByName(with_two("here"), allowMissingColumns=True)
        .groupBy(*run).agg(F.collect_set("there").alias("odd_there"), F.collect_set("here").alias("odd_here"))
    )
    same = F.col("item_slots") == F.col("slots")
    void = ~same & (F.arrays_overlap("item_slots", "odd_there") | F.arrays_overlap("slots", "odd_here"))
    judged = (
        runs.join(odd, run, "left")
        .withColumns({"same": same, "clear": F.col("odd_there").isNull() | ~void})
        .withColumn("share", F.avg(F.col("clear").cast("int")).over(Window.partitionBy(*run)))
        .withColumn("part", F.col("pos") - F.row_number().over(Window.partitionBy(*run, "same").orderBy("pos")))
        .withColumn("long", F.count("*").over(Window.partitionBy(*run, "same", "part")) > WINDOW)
    )
    return judged.filter(F.col("clear") & ((F.col("share") > 0.5) | (F.col("same") & F.col("long"))))


def _with_slots(met: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The windows of ``met`` with the tokens in the item's placeholders, names included, and those
    of the document in their places (``item_slots``, ``slots``)."""
    key = ["id", "th"]
    # Only documents with enough windows are read again; texts are shuffled only if very many have.
    hits = written(met.select(*key).distinct())
    if hits.count() <= BROADCAST_HASHES:
        hits = F.broadcast(hits)
    held = docs.select(known_id("doc_id").alias("id"), text_hash().alias("th"), "text")
    held = held.join(hits, key, "left_semi").dropDuplicates(key)
    held = held.select(*key, tokens(words_only(marked(whole_text()))).alias("words"))
    place = F.struct("item_id", "item_th", "item_pos", "pos", "line", "width")
    grouped = met.groupBy(*key).agg(F.collect_list(place).alias("places"))
    here = held.join(grouped, key).select(
        *key,
        F.inline(
            F.transform("places", lambda p: F.struct(p.alias("p"), F.slice("words", p["pos"] + 1, p["width"]).alias("here")))
        ),
    )
    here = here.select(*key, "p.*", "here")
    there = items.dropDuplicates(key).select(
        F.col("id").alias("item_id"), F.col("th").alias("item_th"),
        tokens(words_only(F.col("marked"))).alias("item_words"), kinds(tokens(_numbers(F.lower(F.col("marked"))))).alias("item_kinds"),
    )
    both = here.join(there, ["item_id", "item_th"])
    at = F.col("item_pos")
    numbers = F.sequence(F.lit(1), F.col("width"))
    filled = F.filter(numbers, lambda i: F.get("item_kinds", at + i - 1) != "w")
    return both.select(
        *key, "item_id", "item_th", "item_pos", "pos", "line",
        F.transform(filled, lambda i: F.get("item_words", at + i - 1)).alias("item_slots"),
        F.transform(filled, lambda i: F.get("here", i - 1)).alias("slots"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, columns as they are.

    Null, empty and very long texts, repeated rows, empty tables and columns of any name: as for
    :func:`find_leaks`; of repeated rows all stay or all go.
    """
    leaks = find_leaks(docs, benchmark, **how).select(ID, TEXT_HASH).distinct()
    rows = docs.withColumns({ID: known_id(), TEXT_HASH: text_hash()})
    return rows.join(leaks, [ID, TEXT_HASH], "left_anti").drop(ID, TEXT_HASH)


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks by document and item; nulls, empty texts and tables as for :func:`find_leaks`."""
    return find_leaks(docs, benchmark).drop(ID, TEXT_HASH)
