"""Compares a query with its SQL on one data folder."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return str(int(v)) if v == int(v) else f"{float(v):.9g}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


def differences(spark_df, con, sql):
    """None, or what differs."""
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = _plain(got), _plain(want)
    if a != b:
        x, y = set(a) - set(b), set(b) - set(a)
        return f"{len(a)} rows, {len(b)} wanted; only here {list(x)[:3]}, only there {list(y)[:3]}"
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got if ("int" in str(got[c].dtype)) != ("int" in str(want[c].dtype)) and not got[c].isna().any() and not want[c].isna().any()]
    return f"types {kinds}" if kinds and len(got) else None
