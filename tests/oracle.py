"""Comparison of a registered query with its SQL twin."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def normalize(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and df[c].isna().any():
            df[c] = [None if pd.isna(v) else str(float(v)) for v in df[c]]
            df[c] = df[c].astype(object)
        elif pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("int64")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(spark, con, folder: str, name: str, fn, sql: str) -> int:
    """Row count if both agree, else AssertionError."""
    got, want = normalize(fn(spark, folder).toPandas()), normalize(con.execute(sql).df())
    assert list(got.columns) == list(want.columns), (name, list(got.columns), list(want.columns))
    assert len(got) == len(want), (name, "rows", len(got), len(want), got.head(), want.head())
    for c in got.columns:
        assert got[c].dtype.kind == want[c].dtype.kind or len(got) == 0, (name, c, got[c].dtype, want[c].dtype)
    diff = ~((got == want) | (got.isna() & want.isna())).all(axis=1)
    assert not diff.any(), (name, int(diff.sum()), got[diff].head(), want[diff].head())
    return len(got)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from recspark.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = connect(folder), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            rows = compare(spark, con, folder, name, fn, sqls[name]) if name in sqls else fn(spark, folder).count()
            print("OK " if name in sqls else "ROWS", name, rows, round(time.time() - start, 1), flush=True)
        except Exception as e:
            print("BAD", name, str(e)[:700], flush=True)
