"""Run all registered queries, compare with SQL, print times: python tests/check_queries.py FOLDER [NAME...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from comparing import database, differences  # noqa: E402
from tallyloom.session import build_session  # noqa: E402

folder, names = sys.argv[1], sys.argv[2:]
spark = build_session(
    "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
    spark__driver__memory="8g",
)
spark.sparkContext.setLogLevel("ERROR")
connection, sql = database(folder), entry.oracle_sql()
bad = 0
for name, run in entry.queries().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        df = run(spark, folder)
        if name in sql:
            verdict = differences(df, connection, sql[name]) or "same"
        else:
            verdict = f"rows {len(df.collect())}"
    except Exception as error:  # report every query, whatever one of them does
        verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
    bad += not verdict.startswith(("same", "rows"))
    print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
print("wrong:", bad)
