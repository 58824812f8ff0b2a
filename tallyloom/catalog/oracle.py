"""The registered queries in plain SQL, written apart from the Spark code."""

from __future__ import annotations

SEED = 42
YEARS = range(1995, 2002)
CODES = ("C1", "C15", "C16", "C18", "banner_pos", "device_type", "site_category", "app_category")

IMPRESSIONS = """
impressions AS (
  SELECT event_id AS id, event_type = 'click' AS click, date_trunc('hour', ts) AS hour,
         k AS "C1", (user_id % 7)::INT AS banner_pos,
         'site_' || (k % 6) AS site_category, 'app_' || (k % 9) AS app_category,
         (user_id % 5)::INT AS device_type, (k % 4)::INT AS device_conn_type,
         (k % 10)::INT AS "C15", (k % 8)::INT AS "C16", (k % 3)::INT AS "C18",
         hour(ts)::INT AS hour_in_day, (isodow(ts) - 1)::INT AS weekday, dayname(ts) AS day_name
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events)
)
"""

LINES = """
impressions AS (
  SELECT l_returnflag = 'R' AS click, l_shipdate AS hour, l_linenumber AS banner_pos,
         (l_suppkey % 5)::INT AS device_type, p_type AS app_category,
         o_orderpriority AS site_category, hour(l_shipdate)::INT AS hour_in_day,
         (isodow(l_shipdate) - 1)::INT AS weekday, dayname(l_shipdate) AS day_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)
"""

_money = ", ".join(
    f"sum(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE AS y{y}"
    for y in YEARS
)
REGIONS = f"""
region_year AS (
  SELECT n_name AS district, {_money}
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name
)
"""

_by_cut_mean = ", ".join(
    f"CASE WHEN y{y} < (SELECT floor(avg(y{y}) * 10000) / 10000 FROM region_all) "
    f"THEN 'Low' ELSE 'High' END AS class_y{y}"
    for y in YEARS
)
_by_mean = ", ".join(
    f"CASE WHEN y{y} < (SELECT avg(y{y}) FROM region_year) THEN 'Low' ELSE 'High' END AS class_y{y}"
    for y in YEARS
)
CLASSED = f"{REGIONS}, classed AS (SELECT *, {_by_mean} FROM region_year)"

SCORED = """
scored AS (
  SELECT d.doc_id, l.quality AS label, least(0.99::DOUBLE, greatest(0.01::DOUBLE, n_chars / 2000.0::DOUBLE)) AS score,
         (least(0.99::DOUBLE, greatest(0.01::DOUBLE, n_chars / 2000.0::DOUBLE)) >= 0.5)::INT AS prediction
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)
"""

PER_CLASS = f"""
{SCORED}, classes AS (SELECT label AS class FROM scored UNION SELECT prediction FROM scored),
counted AS (
  SELECT class,
    (SELECT count(*) FROM scored WHERE label = class) AS support,
    (SELECT count(*) FROM scored WHERE prediction = class) AS predicted,
    (SELECT count(*) FROM scored WHERE label = class AND prediction = class) AS hits
  FROM classes
),
per_class AS (
  SELECT class, support, hits,
    CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted::DOUBLE END AS "precision",
    CASE WHEN support = 0 THEN 0 ELSE hits / support::DOUBLE END AS recall,
    CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * hits / (predicted + support)::DOUBLE END AS f1
  FROM counted
)
"""


def _hash(seed: int, *key: str) -> str:
    parts = " || ".join(f"strlen({c}::VARCHAR) || ':' || {c}::VARCHAR || ';'" for c in key or ("id",))
    return f"('0x' || substr(md5({parts} || '#{seed}'), 1, 15))::BIGINT"


def _hashes(tenths: int) -> int:
    """The given tenths of all 60-bit hashes, to the nearest one."""
    return (tenths * 2**60 + 5) // 10


MODEL_FEATURES = "weekday, hour_in_day, banner_pos, site_category, device_conn_type, app_category, device_type"


def _test_rows(more: str) -> str:
    return f"""SELECT {MODEL_FEATURES}, click::INT AS label, count(*) AS n, {more} FROM impressions
    WHERE {_hash(SEED + 1)} < {_hashes(3)} GROUP BY {MODEL_FEATURES}, label"""


# The names of the nations in the test tables, which become columns.
NATIONS = tuple(f"NATION_{i}" for i in range(25))


PLANTED = f"""{IMPRESSIONS}, planted AS (
  SELECT {_hash(SEED + 1)} < {_hashes(3)} AS is_test, {_hash(7)} < CASE
      WHEN site_category = 'site_1' AND hour_in_day >= 18 THEN {_hashes(8)} WHEN site_category = 'site_1' THEN {_hashes(6)}
      WHEN hour_in_day >= 18 THEN {_hashes(3)} ELSE {_hashes(1)} END AS click
  FROM impressions)"""


def _rates(key: str, source: str = IMPRESSIONS) -> str:
    return f"""
    WITH {source} SELECT {key}, clicks, impressions, round(100.0::DOUBLE * clicks / impressions, 6) AS rate
    FROM (SELECT {key}, count(*) FILTER (click) AS clicks, count(click) AS impressions
          FROM impressions WHERE {key} IS NOT NULL GROUP BY {key})
    WHERE clicks > 0 ORDER BY rate DESC, {key}
    """


def _crosstab(key: str) -> str:
    return f"""
    WITH {IMPRESSIONS} SELECT {key}, nullif(count(*) FILTER (NOT click), 0) AS no_click,
      nullif(count(*) FILTER (click), 0) AS click FROM impressions GROUP BY {key}
    """


def _report(source: str) -> str:
    charts = {
        "hours": "hour_in_day",
        "week_days": "day_name",
        "banner": "banner_pos",
        "device": "device_type",
        "clicks": "'all'",
    }
    parts = " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, ({key})::VARCHAR AS key, count(*) FILTER (click) AS clicks, "
        f"count(*) AS impressions FROM impressions GROUP BY ALL"
        for chart, key in charts.items()
    )
    return f"""
    WITH {source} SELECT chart, key, clicks, impressions,
      round(100.0::DOUBLE * clicks / impressions, 6) AS rate FROM ({parts}) WHERE clicks > 0
    """


def _describe(column: str, table: str) -> str:
    return f"""
    SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 6) AS mean,
      round(stddev_samp({column}), 6) AS std, min({column})::DOUBLE AS min,
      round(quantile_cont({column}::DOUBLE, 0.25), 6) AS p25,
      round(quantile_cont({column}::DOUBLE, 0.5), 6) AS p50,
      round(quantile_cont({column}::DOUBLE, 0.75), 6) AS p75, max({column})::DOUBLE AS max
    FROM {table}
    """


def _long(columns, table: str = "impressions", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {extra}{c}::VARCHAR AS value FROM {table}" for c in columns
    )


def _info() -> str:
    kinds = {
        "id": "bigint", "click": "boolean", "hour": "timestamp_ntz", "C1": "int",
        "banner_pos": "int", "site_category": "string", "app_category": "string",
        "device_type": "int", "device_conn_type": "int", "C15": "int", "C16": "int", "C18": "int",
        "hour_in_day": "int", "weekday": "int", "day_name": "string",
    }
    return f"WITH {IMPRESSIONS} " + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", '{kind}' AS type, "
        f"count({c}) AS non_null FROM impressions"
        for i, (c, kind) in enumerate(kinds.items())
    )


def _one_hot() -> str:
    hot = [f"coalesce((site_category = 'site_{i}')::INT, 0) AS site_category_site_{i}" for i in range(6)]
    hot += [f"coalesce((app_category = 'app_{i}')::INT, 0) AS app_category_app_{i}" for i in range(9)]
    hot += [f"coalesce((banner_pos = {i})::INT, 0) AS banner_pos_{i}" for i in range(7)]
    return f"""
    WITH {IMPRESSIONS} SELECT id, weekday, hour_in_day, device_conn_type, device_type,
      click::INT AS label, {", ".join(hot)} FROM impressions
    """


_classes = ", ".join(f"class_y{y}" for y in YEARS)
_constant = ", ".join(
    f"CASE WHEN y{y} < 20000000 THEN 'Low' ELSE 'High' END AS class_y{y}" for y in YEARS
)
_rollup = ", ".join(f"round(avg(y{y}), 2) AS y{y}" for y in YEARS)
_always = " AND ".join(f"class_y{y} = 'High'" for y in YEARS)
_model_columns = (
    "weekday, hour_in_day, banner_pos, site_category, device_conn_type, app_category, device_type"
)


WIDE = ("id", "hour", "hour_in_day", *CODES)
PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
LATER_DAYS = "2024-01-16"

# Faults of the broken log, by id.
FAULTS = """
faults AS (
  SELECT id, id % 97 = 5 AS cut, id % 89 = 3 AS unclear, id % 83 = 7 AS noon FROM impressions
)
"""


def _slot(column: str, slots: int) -> str:
    return f"(('0x' || substr(md5('{column}=' || {column}::VARCHAR), 1, 15))::BIGINT % {slots})"


def _top(columns, k: int, table: str) -> str:
    return f"""SELECT "column", value, n, place FROM (
      SELECT *, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value))::INT AS place FROM (
        SELECT "column", value, count(*) AS n FROM ({_long(columns, table)}) WHERE value IS NOT NULL GROUP BY ALL))
      WHERE place <= {k}"""


def _collisions(columns, slots: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, {_slot(c, slots)} AS slot, count(*) AS n "
        f"FROM impressions WHERE {c} IS NOT NULL GROUP BY ALL"
        for c in columns
    )
    return f"""
    SELECT "column", sum(v)::BIGINT AS "values", count(*) AS slots,
      coalesce(sum(v) FILTER (v > 1), 0)::BIGINT AS shared_values,
      coalesce(sum(n) FILTER (v > 1), 0)::BIGINT AS shared_rows
    FROM (SELECT "column", slot, count(*) AS v, sum(n) AS n FROM ({parts}) GROUP BY ALL) GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    imp = f"WITH {IMPRESSIONS} "
    regions = f"WITH {REGIONS} "
    classed = f"WITH {CLASSED} "
    scored = f"WITH {SCORED} "
    sql = {
        "parse_hour": imp
        + "SELECT id, strptime(strftime(hour, '%y%m%d%H'), '%y%m%d%H') AS hour FROM impressions",
        "typed_csv_scan": imp + "SELECT id::VARCHAR AS id, * EXCLUDE (id) FROM impressions",
        "reordered_csv_scan": imp
        + "SELECT id::VARCHAR AS id, * EXCLUDE (id), 'x' AS more FROM impressions",
        "inferred_csv_scan": regions
        + "SELECT district, "
        + ", ".join(f"y{y} AS y{y}_total_in_rupees" for y in YEARS)
        + " FROM region_year",
        "report_from_csv": _report(IMPRESSIONS),
        "regional_report_from_csv": f"WITH {REGIONS}, cut AS (SELECT "
        + ", ".join(
            f"CASE WHEN y{y} < (SELECT floor(avg(y{y}) * 10000) / 10000 FROM region_year) "
            f"THEN 'Low Per Capita Income' ELSE 'High Per Capita Income' END "
            f"AS class_y{y}_total_in_rupees"
            for y in YEARS
        )
        + ' FROM region_year) SELECT "column", value, count(*) AS n FROM ('
        + _long([f"class_y{y}_total_in_rupees" for y in YEARS], table="cut")
        + ") GROUP BY ALL",
        "report_by_parts": _report(IMPRESSIONS),
        "counted_parts": imp
        + f"""SELECT CASE WHEN day < '{LATER_DAYS}' THEN 1 ELSE 2 END::BIGINT AS run, day,
          count(*) FILTER (click) AS clicks, count(*) AS impressions
        FROM (SELECT *, strftime(hour, '%Y-%m-%d') AS day FROM impressions) GROUP BY ALL""",
        "published_report": f"""
        SELECT 1 AS "set", * FROM ({_report(
            IMPRESSIONS + f", early AS (SELECT * FROM impressions WHERE hour < '{LATER_DAYS}')"
        ).replace("FROM impressions GROUP", "FROM early GROUP")})
        UNION ALL SELECT 2, * FROM ({_report(IMPRESSIONS)})""",
        "rejected_lines": imp
        + f""", {FAULTS}, marked AS (SELECT CASE WHEN cut OR unclear OR noon THEN 'rejected' ELSE 'good' END AS kind, * FROM faults)
        SELECT reason, count(*) AS rows FROM (
          SELECT 'lines' AS reason FROM faults UNION ALL SELECT kind FROM marked
          UNION ALL SELECT 'fields' FROM faults WHERE cut UNION ALL SELECT 'click' FROM faults WHERE unclear
          UNION ALL SELECT unnest(['hour', 'C1']) FROM faults WHERE noon) GROUP BY 1""",
        "good_lines": imp
        + f""", {FAULTS} SELECT i.id::VARCHAR AS id, i.* EXCLUDE (id) FROM impressions i
        JOIN faults f ON i.id = f.id AND NOT (cut OR unclear OR noon)""",
        "reject_table": imp
        + f""", {FAULTS} SELECT id::VARCHAR AS id, concat_ws(',', CASE WHEN cut THEN 'fields' END,
          CASE WHEN unclear THEN 'click' END, CASE WHEN noon THEN 'hour,C1' END) AS reasons, cut AS has_line
        FROM faults WHERE cut OR unclear OR noon""",
        "merged_distinct": imp
        + f"""SELECT "column", count(DISTINCT value) AS exact, true AS "within", true AS as_direct
        FROM ({_long(WIDE)}) GROUP BY 1""",
        "distinct_by_day": imp
        + f""", days AS (SELECT * FROM impressions WHERE strftime(hour, '%Y-%m-%d') IN ('{LATER_DAYS}', '2024-01-17'))
        SELECT "column", count(DISTINCT value) AS n_distinct FROM ({_long(CODES, "days")}) GROUP BY 1""",
        "sketched_quantiles": imp
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", unnest({list(PROBABILITIES)})::DOUBLE AS probability, "
            f"(SELECT count({c}) FROM {t}) AS count, true AS \"within\""
            for c, t in (("value", "events"), ("user_id", "events"), ('"C1"', "impressions"))
        ).replace("'\"C1\"'", "'C1'"),
        "top_values": imp + _top(CODES, 5, "impressions") + " UNION ALL " + _top(("user_id", "props"), 10, "events"),
        "hashed_slots": imp
        + " UNION ALL ".join(
            f"SELECT hour, id, '{c}' AS \"column\", {_slot(c, 16)} AS slot FROM impressions"
            for c in ("site_category", "app_category", "banner_pos", "id")
        ),
        "hash_collisions": imp + _collisions(("site_category", "app_category", "banner_pos", "C1", "id"), 64),
        "hashed_features": imp
        + "SELECT * FROM ("
        + " UNION ALL ".join(
            [f"SELECT id, '{c}' AS feature, {c}::DOUBLE AS value FROM impressions"
             for c in ("weekday", "hour_in_day", "device_conn_type", "device_type")]
            + [f"SELECT id, '{c}_' || {_slot(c, 16)} AS feature, 1::DOUBLE AS value FROM impressions"
               for c in ("site_category", "app_category", "banner_pos")]
        )
        + ") WHERE value <> 0",
        "sample_exact_k": imp
        + f"SELECT id, click, banner_pos FROM impressions ORDER BY {_hash(SEED)}, id LIMIT 500",
        "sample_exact_once": imp
        + f"SELECT id, click, banner_pos FROM impressions ORDER BY {_hash(SEED)}, id LIMIT 500",
        "report_summary": _report(IMPRESSIONS),
        "profile_info": _info(),
        "table_shape": imp + "SELECT count(*) AS rows, 15::BIGINT AS columns FROM impressions",
        "describe_numeric": imp
        + " UNION ALL ".join(
            [_describe(c, "events") for c in ("value", "user_id")]
            + [_describe(c, "impressions") for c in ("hour_in_day", "weekday", "C1")]
        ),
        "describe_categorical": imp
        + f""", counted AS (SELECT "column", value, count(*) AS n FROM ({_long(CODES)})
              WHERE value IS NOT NULL GROUP BY ALL)
        SELECT "column", sum(n)::BIGINT AS count, count(*) AS "unique",
          first(value ORDER BY n DESC, value) AS top, max(n) AS freq FROM counted GROUP BY 1""",
        "describe_timestamp": imp
        + """, counted AS (SELECT hour, count(*) AS n FROM impressions GROUP BY 1)
        SELECT sum(n)::BIGINT AS count, count(*) AS "unique", first(hour ORDER BY n DESC, hour) AS top,
          max(n) AS freq, min(hour) AS first, max(hour) AS last FROM counted""",
        "head_n": imp + "SELECT * FROM impressions ORDER BY id LIMIT 10",
        "tail_n": imp + "SELECT * FROM impressions ORDER BY id DESC LIMIT 5",
        "column_slice": imp
        + 'SELECT id, click, hour, "C1", banner_pos, site_category FROM impressions ORDER BY id LIMIT 5',
        "distinct_values": imp + "SELECT DISTINCT banner_pos FROM impressions",
        "count_distinct": imp
        + f"""SELECT "column", count(DISTINCT value) AS n_distinct
        FROM ({_long(("hour_in_day", *CODES))}) GROUP BY 1""",
        "filter_clicks": imp + "SELECT * FROM impressions WHERE click",
        "model_columns": imp + f"SELECT id, {_model_columns}, click::INT AS label FROM impressions",
        "regions_in_class": classed + "SELECT district FROM classed WHERE class_y1995 = 'Low'",
        "filter_range": regions + "SELECT * FROM region_year WHERE y1998 >= 20000000",
        "orders_outside_years": """SELECT count(*) FILTER (NOT coalesce(year(o_orderdate) BETWEEN 1996 AND 2001, false)) AS orders,
          coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (NOT coalesce(year(o_orderdate) BETWEEN 1996 AND 2001, false)), 0)::DOUBLE
          AS total, count(*) AS all_orders FROM orders""",
        "classify_constant": regions + f"SELECT *, {_constant} FROM region_year",
        "classify_mean": regions
        + f""", region_all AS (SELECT * FROM region_year UNION ALL BY NAME
                SELECT 'ALL' AS district, {_rollup} FROM region_year)
        SELECT district, {_by_cut_mean} FROM region_all""",
        "rounded_predictions": scored + "SELECT doc_id, round(score)::INT AS prediction FROM scored",
        "calendar_features": imp + "SELECT id, hour_in_day, weekday, day_name FROM impressions",
        "hourly_clicks": imp
        + "SELECT hour, count(*) FILTER (click) AS clicks FROM impressions GROUP BY 1",
        "class_counts": imp + "SELECT click, count(*) AS n FROM impressions GROUP BY 1",
        "click_share": imp
        + """SELECT click, count(*) AS n,
          round(count(*) / (SELECT count(*)::DOUBLE FROM impressions), 6) AS share
        FROM impressions GROUP BY 1""",
        "value_counts": imp
        + "SELECT app_category, count(*) AS n FROM impressions GROUP BY 1 ORDER BY n DESC, 1",
        "value_counts_many": imp
        + f"""SELECT "column", value, count(*) AS n FROM ({_long(CODES)}) GROUP BY ALL""",
        "class_sizes": classed
        + f"""SELECT "column", value, count(*) AS n
        FROM ({_long([f"class_y{y}" for y in YEARS], table="classed")}) GROUP BY ALL""",
        "clicks_by_category": imp
        + """SELECT app_category, count(*) FILTER (click) AS clicks FROM impressions
        GROUP BY 1 ORDER BY clicks DESC, 1""",
        "hourly_clicks_ranked": imp
        + """SELECT hour, count(*) AS clicks FROM impressions WHERE click
        GROUP BY 1 ORDER BY clicks DESC, 1""",
        "impressions_by_banner": imp
        + """SELECT banner_pos, count(click) AS impressions FROM impressions
        GROUP BY 1 ORDER BY 2 DESC, 1""",
        "clicks_by_device": imp
        + """SELECT device_type, count(click) AS clicks FROM impressions WHERE click
        GROUP BY 1 ORDER BY 2 DESC, 1""",
        "crosstab_hour": _crosstab("hour_in_day"),
        "crosstab_day": _crosstab("day_name"),
        "crosstab_banner": _crosstab("banner_pos"),
        "crosstab_device": _crosstab("device_type"),
        "crosstab_category": _crosstab("app_category"),
        "crosstab_code": imp
        + f"""SELECT "column", value, nullif(count(*) FILTER (NOT click), 0) AS no_click,
          nullif(count(*) FILTER (click), 0) AS click
        FROM ({_long(("C1", "C15", "C16", "C18"), extra="click, ")}) GROUP BY ALL""",
        "crosstab_day_clicks": imp
        + "SELECT day_name, count(*) AS click FROM impressions WHERE click GROUP BY 1",
        "device1_hourly_clicks": imp
        + """SELECT hour_in_day, count(*) AS click FROM impressions
        WHERE click AND device_type = 1 GROUP BY 1""",
        "intra_category_share": imp
        + """SELECT app_category, round(nullif(count(*) FILTER (NOT click), 0) / count(*)::DOUBLE, 6)
          AS no_click, round(nullif(count(*) FILTER (click), 0) / count(*)::DOUBLE, 6) AS click
        FROM impressions GROUP BY 1""",
        "ctr_by_hour": _rates("hour_in_day"),
        "ctr_by_hour_bucket": _rates("hour"),
        "ctr_by_day": _rates("day_name"),
        "ctr_by_banner": _rates("banner_pos"),
        "ctr_by_device": _rates("device_type"),
        "ctr_by_device_join": imp
        + """, clicked AS (SELECT device_type, count(*) AS clicks FROM impressions WHERE click GROUP BY 1),
        shown AS (SELECT device_type, count(click) AS impressions FROM impressions GROUP BY 1)
        SELECT device_type, clicks, impressions,
          round(100.0::DOUBLE * clicks / impressions, 6) AS rate
        FROM clicked JOIN shown USING (device_type)""",
        "categories_by_ctr": imp
        + """, r AS (SELECT app_category,
            100.0::DOUBLE * count(*) FILTER (click) / count(click) AS rate
          FROM impressions GROUP BY 1 HAVING count(*) FILTER (click) > 0)
        SELECT row_number() OVER (ORDER BY rate DESC, app_category) AS place, app_category,
          round(rate, 6) AS rate FROM r""",
        "large_ctr_by_day": _rates("day_name", LINES),
        "large_ctr_by_app_category": _rates("app_category", LINES),
        "large_ctr_by_site_category": _rates("site_category", LINES),
        "large_report": _report(LINES),
        "unpivot_series": imp
        + """SELECT hour, 'click' AS variable, count(*) FILTER (click) AS value
        FROM impressions GROUP BY 1""",
        "transpose_wide": regions
        + f""", long AS (UNPIVOT region_year ON {", ".join(f"y{y}" for y in YEARS)}
            INTO NAME variable VALUE value)
        SELECT * FROM (PIVOT long ON district IN ({", ".join(f"'{n}'" for n in NATIONS)})
          USING first(value) GROUP BY variable)""",
        "series_long": regions
        + " UNION ALL ".join(
            f"SELECT district, 'y{y}' AS variable, y{y} AS value FROM region_year" for y in YEARS
        ),
        "top_regions": classed
        + "SELECT district FROM classed WHERE class_y1996 = 'High' ORDER BY 1 LIMIT 5",
        "intersect_two": classed
        + """SELECT district FROM classed WHERE class_y1995 = 'High'
        INTERSECT SELECT district FROM classed WHERE class_y1996 = 'High'""",
        "intersect_all": classed
        + " INTERSECT ".join(
            f"SELECT district FROM classed WHERE class_y{y} = 'High'" for y in YEARS
        ),
        "always_high": classed + f"SELECT DISTINCT district FROM classed WHERE {_always}",
        "bitmap_always_high": classed + f"SELECT DISTINCT district FROM classed WHERE {_always}",
        "bitmap_once_high": classed
        + "SELECT district FROM classed WHERE class_y1995 = 'High' OR class_y1996 = 'High' OR class_y1997 = 'High'",
        "bitmap_class_sizes": classed
        + f"""SELECT "column", value AS class, count(*) AS n
        FROM ({_long([f"class_y{y}" for y in YEARS], table="classed")}) GROUP BY ALL""",
        "semi_union": classed
        + " UNION ALL ".join(
            f"""SELECT district, y{y} AS total, 'y{y}' AS year FROM classed
            WHERE class_y1995 = 'High' AND class_y1996 = 'High' AND class_y1997 = 'High'"""
            for y in (1995, 1996, 1997)
        ),
        "sample_fraction": imp
        + f"SELECT id, click FROM impressions WHERE {_hash(SEED)} < {_hashes(1)}",
        "large_sample_fraction": f"""
        SELECT l_partkey AS part, l_orderkey AS "order", l_linenumber AS banner_pos,
          l_returnflag = 'R' AS click FROM lineitem
        WHERE {_hash(SEED, "l_partkey", "l_orderkey", "l_linenumber")} < {_hashes(1)}""",
        "train_test_split": imp
        + f"SELECT id, click, {_hash(SEED)} < {_hashes(3)} AS is_test FROM impressions",
        "stratified_split": imp
        + f"""SELECT id, click, row_number() OVER (PARTITION BY click ORDER BY {_hash(SEED)}, id)
          <= ceil(0.1 * count(*) OVER (PARTITION BY click)) AS is_test FROM impressions""",
        "stratified_folds": imp
        + f"""SELECT id, click, (ntile(3) OVER (PARTITION BY click ORDER BY {_hash(SEED)}, id) - 1)::INT
          AS fold FROM impressions""",
        "one_hot_table": _one_hot(),
        "feature_matrix": imp
        + "SELECT * FROM ("
        + " UNION ALL ".join(
            [f"SELECT id, '{c}' AS feature, {c}::DOUBLE AS value FROM impressions"
             for c in ("weekday", "hour_in_day", "device_conn_type", "device_type")]
            + [f"SELECT id, '{c}_' || {c} AS feature, 1::DOUBLE AS value FROM impressions"
               for c in ("site_category", "app_category", "banner_pos")]
        )
        + ") WHERE value <> 0",
        "class_weights": imp
        + """SELECT click::INT AS label, count(*) AS n, round((SELECT count(*) FROM impressions)
          / (2.0::DOUBLE * count(*)), 6) AS weight FROM impressions GROUP BY 1""",
        "gbt_test_rows": imp + _test_rows("true AS is_share, true AS follows, true AS by_trees"),
        "rf_test_rows": imp + _test_rows("true AS is_share, true AS follows, true AS by_trees"),
        "gbt_conditions": f"""WITH {PLANTED}, parts AS (
          SELECT is_test, click, count(*) AS n, ceil(0.1 * count(*))::BIGINT AS held FROM planted GROUP BY ALL)
        SELECT 'leaf_means' AS condition, sum(n - held)::BIGINT AS rows, true AS holds FROM parts WHERE NOT is_test
        UNION ALL SELECT 'last_round_is_best', sum(held)::BIGINT, true FROM parts WHERE NOT is_test
        UNION ALL SELECT 'finds_the_effect', sum(n)::BIGINT, true FROM parts WHERE is_test""",
        "rf_conditions": f"""WITH {PLANTED}
        SELECT 'leaf_shares' AS condition, count(*) AS rows, true AS holds FROM planted WHERE NOT is_test
        UNION ALL SELECT 'finds_the_effect', count(*), true FROM planted WHERE is_test""",
        "lr_scores": imp + _test_rows("true AS same"),
        "selected_vectors": imp
        + f""", train AS (SELECT * FROM impressions WHERE NOT {_hash(SEED + 1)} < {_hashes(3)})
        SELECT feature, sum(value)::DOUBLE AS total, true AS "right" FROM ("""
        + " UNION ALL ".join(
            [f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM train"
             for c in ("weekday", "hour_in_day", "device_conn_type", "device_type")]
            + [f"SELECT '{c}_' || {c}, 1::DOUBLE FROM train" for c in ("site_category", "app_category", "banner_pos")]
        )
        + ") GROUP BY 1",
        "path_conditions": "SELECT round(power(10::DOUBLE, -3 + i / 2.0), 6) AS c, true AS at_optimum, true AS f1_holds FROM range(7) t(i)",
        "saved_lr_test_rows": imp + _test_rows("true AS same"),
        "model_report": imp
        + f""", test AS (SELECT click::INT AS label FROM impressions WHERE {_hash(SEED + 1)} < {_hashes(3)})
        SELECT 'f1_path' AS chart, 'penalty_' || (i + 1) AS name, NULL::BIGINT AS support, true AS is_right
        FROM range(7) t(i)
        UNION ALL SELECT 'classification', label::VARCHAR, count(*), true FROM test GROUP BY label
        UNION ALL SELECT 'classification', unnest(['accuracy', 'macro avg', 'weighted avg']),
          (SELECT count(*) FROM test), true""",
        "penalty_rule": "SELECT round(power(10::DOUBLE, -3 + i / 2.0), 6) AS c, true AS rule_holds FROM range(7) t(i)",
        "lr_conditions": imp
        + f"""SELECT unnest(['weekday', 'hour_in_day', 'device_conn_type', 'device_type']) AS feature,
          true AS holds
        UNION ALL SELECT DISTINCT unnest(['site_category_' || site_category,
          'app_category_' || app_category, 'banner_pos_' || banner_pos]), true
        FROM impressions WHERE NOT {_hash(SEED + 1)} < {_hashes(3)}""",
        "ridge_conditions": imp
        + f"""SELECT unnest(['weekday', 'hour_in_day', 'device_conn_type', 'device_type']) AS feature,
          true AS holds
        UNION ALL SELECT DISTINCT unnest(['site_category_' || site_category,
          'app_category_' || app_category, 'banner_pos_' || banner_pos]), true
        FROM impressions WHERE NOT {_hash(SEED + 1)} < {_hashes(3)}""",
        "folded_rows": imp
        + f"SELECT {_model_columns}, click::INT AS label, count(*) AS n FROM impressions GROUP BY ALL",
        "confusion_matrix": scored
        + """SELECT label, count(*) FILTER (prediction = 0) AS predicted_0,
          count(*) FILTER (prediction = 1) AS predicted_1 FROM scored GROUP BY 1""",
        "accuracy": scored + "SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM scored",
        "classification_report": f"""WITH {PER_CLASS}
        SELECT class::VARCHAR AS class, round("precision", 6) AS "precision", round(recall, 6) AS recall,
          round(f1, 6) AS f1, support FROM per_class
        UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support)::DOUBLE, 6),
          round(sum(hits) / sum(support)::DOUBLE, 6), round(sum(hits) / sum(support)::DOUBLE, 6),
          sum(support)::BIGINT FROM per_class
        UNION ALL SELECT 'macro avg', round(avg("precision"), 6), round(avg(recall), 6),
          round(avg(f1), 6), sum(support)::BIGINT FROM per_class
        UNION ALL SELECT 'weighted avg', round(sum("precision" * support) / sum(support), 6),
          round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
          sum(support)::BIGINT FROM per_class""",
        "weighted_f1": f"""WITH {PER_CLASS}
        SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM per_class""",
        "roc_auc": scored
        + """, ranked AS (
          SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS by_score,
            rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0::DOUBLE AS by_prediction
          FROM scored),
        sums AS (
          SELECT count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n,
            sum(by_score) FILTER (label = 1) AS s, sum(by_prediction) FILTER (label = 1) AS h FROM ranked)
        SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auc_score, round((h - p * (p + 1) / 2) / (p * n), 6) AS auc_hard
        FROM sums""",
        "log_loss": scored
        + """SELECT round(-avg(CASE WHEN label = 1 THEN ln(score) ELSE ln(1 - score) END), 6) AS log_loss
        FROM scored""",
    }
    return sql
