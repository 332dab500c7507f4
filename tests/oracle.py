"""Comparison of a query with its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd

from tests.conftest import SF


def views() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v) + 0.0:.5g}" if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def check(spark, query, sql: str) -> None:
    a, b = query(spark, SF).toPandas(), views().execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canonical(a) == canonical(b)
