"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs, as short texts; empty when the results are equal."""
    relation = con.sql(sql)
    if sorted(spark_df.columns) != sorted(relation.columns):
        return [f"columns {sorted(spark_df.columns)} / {sorted(relation.columns)}"]
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = rows(relation.columns, relation.fetchall())
    found = []
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} / {len(theirs)} rows")
    left, right = set(map(repr, ours)), set(map(repr, theirs))
    found += [f"only here: {r[:300]}" for r in sorted(left - right)[:3]]
    found += [f"only in oracle: {r[:300]}" for r in sorted(right - left)[:3]]
    if not found and ours != theirs:
        found.append("repeated rows differ")
    return found
