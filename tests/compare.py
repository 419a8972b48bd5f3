"""Compare a Spark result with DuckDB SQL over the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: "" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(list(v)) if isinstance(v, list | np.ndarray) else str(v))
        elif df[c].dtype.kind in "iufb" or str(df[c].dtype)[0] in "IFb":
            df[c] = df[c].astype("Float64").fillna(-9e99).astype(float)
    return df.sort_values(list(df.columns), ignore_index=True)


def assert_same(spark_df, con, sql: str) -> None:
    mine, other = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    pd.testing.assert_frame_equal(_plain(mine), _plain(other), check_dtype=False, rtol=1e-9, atol=1e-9)
