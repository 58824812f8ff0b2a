"""Comparing a Spark result with a DuckDB result, whatever their row order."""

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# DuckDB's names for the types Spark results have.
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def database(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(folder) / name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in data)


def differences(df, connection, sql):
    """Empty when columns, types and rows agree."""
    found = connection.sql(sql)
    theirs = dict(zip(found.columns, (str(t) for t in found.types)))
    ours = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    if ours != theirs:
        odd = {n: (ours.get(n), theirs.get(n)) for n in ours | theirs if ours.get(n) != theirs.get(n)}
        return f"types (ours, theirs): {odd}"
    left = rows(df.columns, df.collect())
    right = rows(found.columns, found.fetchall())
    if left == right:
        return ""
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return f"{len(left)} rows against {len(right)}; only ours {only_left}; only theirs {only_right}"
