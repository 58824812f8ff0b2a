"""Spelling variants by an index of grams of variable length.

Frequent grams of the vocabulary form a dictionary. A word is cut into grams that grow, code
point by code point, for as long as they are frequent; so one edit reaches a number of grams
that can be told for every word. Near words share all the others, with the same text before or
after them. A word is listed under its rarest grams, one more than an edit can reach; the lists
are merged, and the pairs that meet are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tallyloom.llm.shared import LOWER, UPPER, ascii_lower, removed, stored, written
from tallyloom.llm.sql import crc32_sql

# Letters of a word, share of runs that are changed, and what counts as a word.
LETTERS = r"A-Za-zÀ-ÿ"
CHANGE_EVERY = 31
MIN_LENGTH, MIN_COUNT = 7, 2
#: A word is a variant of one that is so many times as frequent.
RATIO = 10
#: Code points of the shortest and the longest gram.
SHORTEST, LONGEST = 2, 6
#: A gram is frequent in more words than this, and in so many that the dictionary has at most
#: FREQUENT grams of each length (the executors hold it).
LIST_WORDS, FREQUENT = 64, 50_000
#: Lists are merged pair by pair up to this length, longer ones are cut further.
PAIRED_WORDS = 256
#: Low bits of a list's key: its longest gram.
LEVEL_BITS = 3
#: Words that one task makes the postings of, and postings that one task group should hold.
TASK_WORDS, GROUP_ROWS = 20_000, 100_000
#: Words beyond this length are verified one by one, shorter ones in arrays.
ARRAY_LETTERS = 32


def occurrences(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """``word`` of every run of letters that gives at least ``least`` code points."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), run.alias("run"))
    runs = runs.select(ascii_lower(F.col("run")).alias("run"), F.concat_ws(":", "id", ascii_lower(F.col("run"))).alias("s"), "id")
    h = F.when(F.col("id").isNotNull(), F.crc32("s"))
    rows = runs.select("run", h.alias("h"), F.char_length("run").alias("length"))
    at = F.pmod("h", F.col("length").cast("bigint")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % CHANGE_EVERY == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.char_length("word") >= least)


def vocabulary(docs: DataFrame, least: int = MIN_LENGTH, count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n`` of the words found at least ``count`` times."""
    return occurrences(docs, least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The dictionary: frequent grams shorter than ``LONGEST``, with the words they are in
    (counted as often as they occur)."""
    length = F.char_length("word")
    sizes = [F.sum(F.greatest(length - q + 1, F.lit(0))).alias(str(q)) for q in range(SHORTEST, LONGEST)]
    totals = words.agg(*sizes).first()
    least = F.lit(0)
    for q in range(SHORTEST, LONGEST):
        most = max(LIST_WORDS, math.ceil((totals[str(q)] or 0) / FREQUENT))
        least = F.when(F.char_length("gram") == q, most).otherwise(least)
    grams = F.flatten(
        F.array(
            *[
                F.transform(
                    F.when(length >= q, F.sequence(F.lit(1), length - q + 1)).otherwise(F.array().cast("array<int>")),
                    lambda i, q=q: F.substr("word", i, F.lit(q)),
                )
                for q in range(SHORTEST, LONGEST)
            ]
        )
    )
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r.gram: r.n for r in counts.filter(F.col("n") > least).collect()}


def cut_into_grams(word: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the word's grams: at every start the shortest gram, longer while it is
    frequent; grams inside others are left out."""
    grams, reached, n = [], 0, len(word)
    for start in range(n - SHORTEST + 1):
        end = start + SHORTEST
        while end < n and end - start < longest and word[start:end] in frequent:
            end += 1
        if end > reached:
            grams.append((start, end))
            reached = end
        if reached == n:
            break
    return grams


def affected_by_one_edit(word: str, grams: list[tuple[int, int]], longest: int, endings: set[str]) -> int:
    """The most grams that one inserted, deleted or replaced code point can change.

    Those that hold the place; and a gram after it that is shorter than the longest, if a
    frequent gram ends like its text between the place and its last code point, as one that
    starts earlier may then grow over it.
    An edit before the first code point is looked at apart; other insertions reach no more
    than a replacement of the code point before them.
    """
    reach, before = [0] * len(word), 0
    for start, end in grams:
        for i in range(start, end):
            reach[i] += 1
        for i in range(max(0, end - longest), start):
            if word[i + 1 : end - 1] in endings:
                reach[i] += 1
        before += end < longest and word[: end - 1] in endings
    return max(*reach, before)


def level_of(shorter: int) -> int:
    """The longest gram of the lists in which a word is compared with equally long and longer ones."""
    return min(LONGEST, shorter // 2)


def _key(level: int, *parts: object) -> int:
    """64 bits as a signed number, the last of them the level. Equal keys of different lists make
    lists longer, not results wrong."""
    bits = xxh3_64_intdigest("\n".join(map(str, parts))) >> LEVEL_BITS << LEVEL_BITS | level
    return bits - (bits >> 63 << 64)


def listed_under(word: str, frequent: dict[str, int], endings: set[str]) -> list[tuple[int, int, int]]:
    """(key, start, end) of the lists a word is in: a gram with all before it, or a gram with all
    after it. What lies from start to end, on the other side, is open."""
    found = []
    for level in sorted({level_of(len(word) - 1), level_of(len(word))}):
        grams = cut_into_grams(word, level, frequent)
        reach = affected_by_one_edit(word, grams, level, endings)
        rare = sorted(grams, key=lambda g: (frequent.get(word[slice(*g)], 0), word[slice(*g)], g))
        for start, end in rare[: reach + 1]:
            found.append((_key(level, "before", word[:end]), end, len(word)))
            found.append((_key(level, "after", word[start:]), 0, start))
    return found


def halved(key: int, word: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the parts of a long list that a word is in.

    The open parts of two near words of a list are one edit apart: what stands on one side of the
    middle is the same. Words of one length are cut at their middle; a longer one meets those that
    are shorter by one where it is cut at theirs. Parts of one open place or none need no further
    cut: their words are near, or differ in what was cut.
    """
    level, opened = key & (1 << LEVEL_BITS) - 1, word[start:end]
    for size in (len(opened), len(opened) - 1):
        longer = len(opened) > size
        if size < 0:
            continue
        if size == 0:
            yield _key(level, key, 0), 0, 0
        elif size == 1:
            for code in set(opened):
                yield _key(level, key, 1, code), 0, 0
            if not longer:
                yield _key(level, key, 1), 0, 0
        else:
            half = size // 2
            yield _key(level, key, size, "a", opened[:half]), start + half, end
            yield _key(level, key, size, "b", opened[half + longer :]), start, start + half + longer


def _aligned(words: list[bytes], right: bool) -> np.ndarray:
    side = bytes.rjust if right else bytes.ljust
    fill = b"\x01" if right else b"\x02"
    return np.frombuffer(b"".join(side(w[:ARRAY_LETTERS], ARRAY_LETTERS, fill) for w in words), np.uint8).reshape(
        -1, ARRAY_LETTERS
    )


def one_edit_apart(a: str, b: str) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[head + (len(a) == len(b)) :] == b[head + 1 :]


class Pairs:
    """Verifies pairs of words by position, many at a time."""

    def __init__(self, words: list[str]):
        codes = [w.encode("latin-1") for w in words]
        self.words = words
        self.length = np.array([len(w) for w in words])
        self.left, self.right = _aligned(codes, False), _aligned(codes, True)
        signs = np.zeros(len(words), np.uint64)
        for column in self.left.T:  # which letters a word has, as bits
            signs |= np.where(column > 2, np.left_shift(np.uint64(1), (column & 63).astype(np.uint64)), np.uint64(0))
        self.signs = signs

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs are one edit apart."""
        close = np.abs(self.length[a] - self.length[b]) <= 1
        long = np.maximum(self.length[a], self.length[b]) > ARRAY_LETTERS
        # One edit takes away one letter and brings one at most.
        close &= long | (np.bitwise_count(self.signs[a] ^ self.signs[b]) <= 2)
        at = np.flatnonzero(close)
        a, b, long = a[at], b[at], long[at]

        def shared(side: np.ndarray) -> np.ndarray:
            differ = side[a] != side[b]
            return np.where(differ.any(axis=1), differ.argmax(axis=1), ARRAY_LETTERS)

        same = shared(self.left) + shared(self.right[:, ::-1])
        shorter = np.minimum(self.length[a], self.length[b])
        equal = self.length[a] == self.length[b]
        good = np.where(equal, same == shorter - 1, same >= shorter)
        for i in np.flatnonzero(long):
            good[i] = one_edit_apart(self.words[a[i]], self.words[b[i]])
        return at[good]


def near_words(words: DataFrame) -> DataFrame:
    """(``word``, ``near``, ``n``): every near word of every word, with the near word's count,
    for ``words`` with ``word`` (different words of at least ``MIN_LENGTH`` letters) and ``n``.
    Rows may repeat.

    No list is dropped or cut short. Lists of more than ``PAIRED_WORDS`` words are cut by the halves
    of what is open in them, again and again until they are short or their words differ in one
    place. So a task group holds a bounded number of postings, and pairs that are no links never
    leave it.
    """
    frequent = frequent_grams(words)
    endings = {g[k:] for g in frequent for k in range(1, len(g))}
    schema = "key bigint, start int, end int, word string, n bigint"
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())

    def rows_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "end", "word", "n"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = zip(batch.column("word").to_pylist(), batch.column("n").to_pylist())
            yield from rows_of([(*at, word, n) for word, n in named for at in listed_under(word, frequent, endings)])

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = zip(*(batch.column(c).to_pylist() for c in ("key", "word", "start", "end", "n")))
            yield from rows_of([(*at, r[1], r[4]) for r in named for at in halved(*r[:4])])

    # The vocabulary is small beside the work that a word makes.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, math.ceil(words.count() / TASK_WORDS))
    rows, path = stored(words.select("word", "n").repartition(tasks, "word").mapInArrow(post, schema))
    lists, postings = None, 0
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("end") - F.col("start")).alias("open"))
        # Lists of one word meet nobody.
        shared = written(rows.join(sizes.filter("size > 1"), "key"))
        removed(words.sparkSession, path)
        long = (F.col("size") > PAIRED_WORDS) & (F.col("open") > 0)
        counts = shared.agg(F.count_if(long).alias("long"), F.count_if(~long).alias("short")).first()
        short = shared.filter(~long).select("key", "word", "n")
        lists, postings = short if lists is None else lists.unionByName(short), postings + counts["short"]
        if not counts["long"]:
            break
        rows, path = stored(shared.filter(long).select("key", "word", "start", "end", "n").mapInArrow(halve, schema))
    groups = max(1, math.ceil(postings / GROUP_ROWS))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        words = rows["word"].tolist()
        pairs = Pairs(words)
        ends = np.searchsorted(key, key, side="right")
        place = np.arange(len(key))
        level = key & (1 << LEVEL_BITS) - 1
        found, apart = [], 1
        while True:  # every word with the next one of its list, the one after that, ...
            place = place[place + apart < ends[place]]
            if not len(place):
                break
            # Words of two levels are compared in that of the shorter one.
            shorter = np.minimum(pairs.length[place], pairs.length[place + apart])
            a = place[np.minimum(LONGEST, shorter // 2) == level[place]]
            good = a[pairs.near(a, a + apart)]
            found.append(np.stack([good, good + apart]))
            apart += 1
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=int)
        here, there = np.concatenate([a, b]), np.concatenate([b, a])
        words = np.array(words, dtype=object)
        return pd.DataFrame({"word": words[here], "near": words[there], "n": n[there]}).drop_duplicates()

    bucket = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("bucket")
    return (
        lists.select(bucket, "key", "word", "n").groupBy("bucket")
        .applyInPandas(merge, "word string, near string, n bigint")
    )


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every row of ``words``.

    A word's form is its most frequent near word (of equally frequent ones the first by code
    point), if that is at least ``ratio`` times as frequent; the root is found by going from form
    to form. As counts grow by ``ratio``, the way is short and never turns back.
    """
    words = written(words)
    # A word has few near words: places times letters at most.
    links = F.collect_set(F.struct((-F.col("n")).alias("n"), "near"))
    best = near_words(words).groupBy("word").agg(links.alias("links"))
    best = best.select("word", F.size("links").cast("bigint").alias("n_near"), F.array_min("links").alias("top"))
    joined = words.join(best, "word", "left")
    has_form = -F.col("top.n") >= ratio * F.col("n")
    rows = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has_form, F.col("top.near")).alias("form"), F.when(has_form, -F.col("top.n")).alias("form_n"),
        )
    )
    ways = written(rows.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:  # every step doubles the way that is known
        step = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = ways.join(step, "root", "left")
        if not longer.filter("next is not null").limit(1).count():
            break
        ways = written(longer.select("word", F.coalesce("next", "root").alias("root")))
    found = rows.join(ways, "word", "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variant_report(docs: DataFrame) -> DataFrame:
    """The spelling variants among the words of ``documents``.

    A word is a run of letters in lower case (A-Z alone), of whole texts; every
    ``CHANGE_EVERY``-th run, by crc32 of ``<doc_id>:<run>``, has lost a code point. Runs of a row
    without id are taken as they are. Null and empty texts have no words, repeated rows count
    each, empty tables give no rows, further columns are not read.
    """
    found = variants(vocabulary(docs))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


_CHECKSUM = crc32_sql("concat(doc_id, ':', run)")
ORACLE_SQL = f"""
WITH runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run
  FROM documents),
marked AS MATERIALIZED (SELECT run, CASE WHEN doc_id IS NOT NULL THEN {_CHECKSUM} END AS h FROM runs),
words AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % {CHANGE_EVERY} = 0
      THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
    FROM marked)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING count(*) >= {MIN_COUNT}),
cut AS MATERIALIZED (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON b.rest = a.word
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON b.rest = a.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS n FROM links GROUP BY word),
found AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= {RATIO} * w.n THEN b.near END AS form,
    CASE WHEN b.n >= {RATIO} * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
ways AS (
  WITH RECURSIVE way(word, root) AS (
    SELECT word, word FROM words UNION ALL SELECT y.word, f.form FROM way y JOIN found f ON f.word = y.root WHERE f.form IS NOT NULL)
  SELECT y.word, y.root FROM way y JOIN found f ON f.word = y.root WHERE f.form IS NULL)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n FROM found f JOIN ways y USING (word)
"""
