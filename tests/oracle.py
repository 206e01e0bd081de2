"""Compares a query with its SQL on the same tables, rows as a multiset, numbers to six decimals."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("SKERRY_TEST_DATA", "/root/testdata/sf0.001")


def connect(directory: str = DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else round(float(value), 6) + 0.0
    return value if value is None else str(value)


def rows(records, columns):
    order = sorted(columns)
    return sorted((tuple(plain(r[c]) for c in order) for r in records), key=repr)


def compare(spark, con, query, sql: str, directory: str = DATA) -> None:
    got = query(spark, directory).toArrow()
    want = con.sql(sql).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    assert rows(got.to_pylist(), got.schema.names) == rows(want.to_pylist(), want.schema.names)
