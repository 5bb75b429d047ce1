"""Compares a query with its SQL on a data folder."""

import os
from pathlib import Path

import duckdb
import pandas as pd

SMALL = os.environ.get("EPOCHLOOM_TEST_DIR", "/root/testdata/sf0.001")


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        v = df[c]
        if pd.api.types.is_numeric_dtype(v) and not pd.api.types.is_bool_dtype(v):
            out[c] = v.astype("float64").round(5).map(lambda x: repr(x + 0.0))
        elif pd.api.types.is_datetime64_any_dtype(v):
            out[c] = v.astype("datetime64[us]").astype(str)
        else:
            out[c] = v.map(lambda x: repr([round(float(y), 5) for y in x]) if hasattr(x, "__len__") and not isinstance(x, str) else "nan" if x is None or x != x else str(x))
    cols = sorted(df.columns)
    return pd.DataFrame(out, columns=cols).sort_values(cols).reset_index(drop=True)


def check(spark, query, sql: str, folder: str = SMALL) -> None:
    ours, theirs = query(spark, folder).toPandas(), connection(folder).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    pd.testing.assert_frame_equal(normal(ours), normal(theirs))
