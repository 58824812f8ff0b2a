"""Lists of URL rules behind a blocked Bloom filter.

A rule is a host and the beginning of a path. The rules' canonical keys fill a Bloom filter
whose bits for one key lie in one block of 512. The keys that a URL could be listed under are
looked up there; those that may be listed go on to a join with the list itself, which removes
what the filter let through by chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import LOWER, UPPER, ascii_lower, written

BLOCK_BITS, WORD_BITS = 512, 64
WORDS = BLOCK_BITS // WORD_BITS
#: Bits of the filter for a listed key, and bits set for it.
KEY_BITS, PROBES = 12, 6
#: The filter has at most so many blocks (64 bytes each), which go to every executor. A longer
#: list fills it more, so more URLs go to the join; the result is the same.
MAX_BLOCKS = 1 << 17
#: Rules that are sent to every executor; more are joined by shuffle.
BROADCAST_RULES = 100_000
#: A rule is listed under its last labels and the beginning of its path, up to so many labels
#: and code points; the join compares the rest.
KEY_LABELS, KEY_PATH = 8, 128
PROBE_BITS = 9

# The rules that pages are judged by (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: What a URL is that no rule lists.
UNLISTED = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (A-Z alone) and the path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _tail(labels: Column, n: Column) -> Column:
    """The last ``n`` labels of a host as text."""
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def _listed(rules: DataFrame) -> DataFrame:
    """Different rules that can fit a URL, with the key each is listed under and its shape."""
    labels = F.split("host", r"\.")
    return (
        rules.filter("host is not null and path is not null and verdict is not null")
        .select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumns({"rule": F.concat("host", "path"), "n_labels": F.least(F.size(labels), F.lit(KEY_LABELS))})
        .withColumn("n_path", F.least(F.char_length("path"), F.lit(KEY_PATH)))
        .withColumn("key", F.concat(_tail(labels, F.col("n_labels")), F.substr("path", F.lit(1), F.col("n_path"))))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _probe(key: Column, number: int) -> Column:
    """Place in its block of the key's bit of that number."""
    return F.shiftright(F.xxhash64(F.lit(1), key), number * PROBE_BITS).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of a column ``key``: ``block`` and its words ``w0`` to ``w7``; blocks without
    a bit have no row."""
    probes = F.array(*[_probe(F.col("key"), j) for j in range(PROBES)])
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(probes).alias("at"))
    bit = F.expr(f"shiftleft(1L, at % {WORD_BITS})")
    words = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / WORD_BITS) == j, bit)), F.lit(0)).cast("bigint").alias(f"w{j}")
        for j in range(WORDS)
    ]
    return bits.groupBy("block").agg(*words)


def may_hold(key: Column) -> Column:
    """Whether the words of the key's block have all its bits."""
    words = F.array(*[f"w{j}" for j in range(WORDS)])
    tests = []
    for j in range(PROBES):
        at = _probe(key, j)
        word = F.get(words, F.floor(at / WORD_BITS).cast("int"))
        tests.append(F.call_function("shiftright", word, at % WORD_BITS).bitwiseAND(F.lit(1)) == 1)
    found = tests[0]
    for test in tests[1:]:
        found = found & test
    return F.coalesce(found, F.lit(False))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", unlisted: str = UNLISTED) -> DataFrame:
    """The columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (in place of
    columns of those names).

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains of
    it if the path starts with the rule's; the longest (host and path together, then the longer
    host) decides. Rules with a null fit nothing; of the same host and path the last verdict in
    alphabetical order holds (block before allow). URLs that no rule fits are ``unlisted``, null
    URLs and those without ``://`` among them: their host and path are empty. Repeated rows are
    judged each, empty tables and lists give no rows and no rules. URLs of any length are taken
    whole: of a URL only beginnings of the lengths that rules have are looked up.

    The filter has a bounded size. What it lets through is joined by key: with the list sent
    to all up to ``BROADCAST_RULES`` rules, by shuffle beyond. There URLs that may be listed
    nowhere have a key each, and hot keys are split as any skewed join.
    """
    spark = pages.sparkSession
    listed = written(_listed(rules))
    keys = listed.select("key").distinct()
    n = keys.count()
    blocks = max(1, min(MAX_BLOCKS, math.ceil(n * KEY_BITS / BLOCK_BITS)))
    bloom = written(bloom_filter(keys, blocks))
    # At most KEY_LABELS x (KEY_PATH + 1) shapes.
    shapes = sorted(tuple(r) for r in listed.select("n_labels", "n_path").distinct().collect())

    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url))
    rows = pages.select(
        F.struct(*others).alias("_row"), host.alias("_host"), path.alias("_path"),
        F.monotonically_increasing_id().alias("_rid"),
    )
    labels = F.split("_host", r"\.")
    possible = [
        F.when(
            (F.size(labels) >= k) & (F.char_length("_path") >= m),
            F.concat(_tail(labels, F.lit(k)), F.substr("_path", F.lit(1), F.lit(m))),
        )
        for k, m in shapes
    ]
    candidates = F.filter(F.array(*possible).cast("array<string>"), lambda key: key.isNotNull())
    looked_up = (
        rows.withColumn("_key", F.explode_outer(candidates)).withColumn("block", _block(F.col("_key"), blocks))
        .join(F.broadcast(bloom), "block", "left")
        # A key that no rule has, and no two rows share.
        .withColumn("_key", F.when(may_hold(F.col("_key")), F.col("_key")).otherwise(F.concat(F.lit("\n"), "_rid")))
        .select("_row", "_host", "_path", "_rid", "_key")
    )
    if listed.count() <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    fits = ((F.col("_host") == F.col("host")) | F.endswith("_host", F.concat(F.lit("."), "host"))) & F.startswith(
        F.col("_path"), F.col("path")
    )
    best = F.max(F.when(fits, F.struct(F.char_length("rule").alias("n"), F.char_length("host"), "verdict", "rule")))
    judged = (
        looked_up.join(listed, F.col("_key") == F.col("key"), "left")
        .groupBy("_rid", "_host", "_path", "_row").agg(best.alias("_best"))
    )
    return judged.select(
        "_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(unlisted)).alias("verdict"),
    )


def url_report(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every page by ``RULES``."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url")
    return judge(rows, rules).drop("url")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = rf"""
WITH rules(host, path, verdict) AS (VALUES {_VALUES}),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM p),
f AS (
  SELECT q.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM q LEFT JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{UNLISTED}') AS verdict FROM f WHERE n = 1
"""
