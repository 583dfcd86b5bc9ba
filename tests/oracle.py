"""Run a query and its SQL twin and compare columns, row counts and values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value + 0.0 if isinstance(value, float) else value


def rows(table):
    columns = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in columns]
    return columns, sorted((tuple(plain(v) for v in row) for row in zip(*data)), key=repr)


def differences(spark, con, query, sql, sf_dir):
    """None if both agree, else a short description."""
    ours = query(spark, sf_dir).toArrow()
    theirs = con.execute(sql).to_arrow_table()
    a_columns, a = rows(ours)
    b_columns, b = rows(theirs)
    if a_columns != b_columns:
        return f"columns {a_columns} != {b_columns}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ in {a_columns}, first {wrong[0]}"
    return None
