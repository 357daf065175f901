"""Rows of a DataFrame and of DuckDB SQL in one comparable form."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{DATA}/{sf}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{sf}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def spark_rows(df) -> tuple[list[str], list[str]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[str]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())
