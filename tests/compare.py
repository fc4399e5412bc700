"""Spark rows against DuckDB rows: the same columns and values in any order."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canonical(df: pd.DataFrame) -> list[str]:
    def cell(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        try:
            return f"{float(v):.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    df = df.reindex(sorted(df.columns), axis=1)
    return sorted("|".join(cell(v) for v in r) for r in df.itertuples(index=False))


def same(spark, con, query, sql: str, sf: str) -> None:
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert a == b, f"only Spark {sorted(set(a) - set(b))[:3]}, only SQL {sorted(set(b) - set(a))[:3]}"
