"""Run a Spark query and its SQL text on the same files and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value) -> str:
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    return "NULL" if value is None else str(value)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf: str) -> str | None:
    """None if equal, else what differs."""
    frame = query(spark, sf)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    want_columns, want = rows_of(names, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    spark_kinds = dict(frame.dtypes)
    for name, kind in zip(names, kinds):
        pair = (spark_kinds[name], kind)
        if pair not in {
            ("string", "VARCHAR"), ("bigint", "BIGINT"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"), ("int", "INTEGER"),
            ("string", "STRING"), ("bigint", "NUMBER"), ("double", "NUMBER"), ("boolean", "bool"),
        }:
            return f"type of {name}: {pair}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    different = [(g, w) for g, w in zip(got, want) if g != w]
    if different:
        return f"{len(different)} of {len(got)} rows differ, e.g. {different[:2]}"
    return None
