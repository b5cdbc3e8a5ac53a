"""Rows of a Spark result and of DuckDB as equal lists."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _cell(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [tuple(sorted(names))] + sorted(tuple(_cell(r[k]) for k in order) for r in found)


def of_spark(df) -> list[tuple]:
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(con, sql: str) -> list[tuple]:
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall())
