"""Side-by-side comparison of a query with its SQL oracle."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: bytes(v) if isinstance(v, (bytearray, memoryview)) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    want_rows = rows_of(columns, want.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {df.columns} {columns}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got != want_rows:
        bad = next((i for i, (a, b) in enumerate(zip(got, want_rows)) if a != b), None)
        return f"{len(got)} rows, oracle {len(want_rows)}; first difference {got[bad] if bad is not None else ''} | {want_rows[bad] if bad is not None else ''}"
    return ""
