"""Runs queries beside their SQL oracle."""

import os
from pathlib import Path

import duckdb
import pandas as pd


def connect(base: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(base).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def canon(df: pd.DataFrame) -> list:
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return round(float(v), 4) + 0.0 if isinstance(v, float) else str(v) if isinstance(v, pd.Timestamp) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=str)


def same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
