"""Line dedup: lines that several documents hold stay in the first of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import SPACES, ascii_lower, known_id, text_hash, whole_text

MIN_CHARS = 10
MIN_DOCS = 2
# Working columns carry a prefix no table uses, so any extra column may ride along.
ID, TEXT_HASH, POS, KEY, H1, H2 = ("_line_" + x for x in ("id", "th", "pos", "key", "h1", "h2"))
FIRST, LAST, DOCS, GONE, KEPT = ("_line_" + x for x in ("first", "last", "docs", "gone", "kept"))


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Position and 128-bit hash of every line long enough to count."""
    lines = docs.select(ID, TEXT_HASH, F.posexplode(F.split("text", "\n")).alias(POS, KEY))
    keys = lines.select(ID, TEXT_HASH, POS, line_key(F.col(KEY)).alias(KEY))
    return keys.filter(F.char_length(KEY) >= min_chars).select(
        ID,
        TEXT_HASH,
        POS,
        F.xxhash64(F.lit(1), F.col(KEY)).alias(H1),
        F.xxhash64(F.lit(2), F.col(KEY)).alias(H2),
    )


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """All columns of ``docs`` with the repeated lines gone from ``text``, plus ``n_lines`` and
    ``n_dropped`` (which replace columns of those names).

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses its
    lines everywhere but in the smallest ``doc_id`` holding it. A null or empty text is one
    empty line. A null id is one document, after all others; repeated ids are one document
    too. Very long texts are split inside one row. An empty table gives an empty table.

    Lines travel as two hashes and a position. Counting combines in the map tasks, so a line
    that a third of all documents hold is one row per task; the join that follows has one
    row per key on its small side, and adaptive execution splits its hot keys. Texts are
    shuffled once, to meet the positions they lose.
    """
    keyed = docs.withColumns(
        {ID: known_id(), TEXT_HASH: text_hash(), "text": whole_text()}
    )
    keys = _keys(keyed, min_chars)
    totals = [F.min(ID).alias(FIRST), F.max(ID).alias(LAST)]
    if min_docs > 2:
        totals.append(F.count_distinct(ID).alias(DOCS))
    firsts = keys.groupBy(H1, H2).agg(*totals).filter(F.col(FIRST) < F.col(LAST))
    if min_docs > 2:
        firsts = firsts.filter(F.col(DOCS) >= min_docs)
    gone = (
        keys.join(firsts.select(H1, H2, FIRST), [H1, H2])
        .filter(F.col(ID) > F.col(FIRST))
        .groupBy(ID, TEXT_HASH)
        .agg(F.collect_set(POS).alias(GONE))
    )
    lines = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(GONE))
    # The lines are bound to a variable once, not split again for every place.
    picked = F.transform(F.array(lines), lambda all_: F.transform(places, lambda p: F.get(all_, p)))
    kept = F.when(F.col(GONE).isNotNull(), F.get(picked, F.lit(0)))
    dropped = F.coalesce(F.array_size(GONE), F.lit(0)).cast("bigint")
    return (
        keyed.join(gone, [ID, TEXT_HASH], "left")
        .withColumns(
            {
                "n_lines": F.size(lines).cast("bigint"),
                "n_dropped": dropped,
                "text": F.coalesce(F.array_join(kept, "\n"), F.col("text")),
            }
        )
        .drop(ID, TEXT_HASH, GONE)
    )


def dedup_digest(docs: DataFrame) -> DataFrame:
    """The result of the line dedup by document, with the kept text as a hash."""
    done = drop_repeated_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), firsts AS (
    SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
    GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT keyed.*, first IS NOT NULL AND doc_id > first AS gone
    FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
