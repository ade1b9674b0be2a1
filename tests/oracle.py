"""Compare registered queries with their SQL counterparts on one scale factor."""

from __future__ import annotations

import pathlib

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def _cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return repr([_cell(x) for x in v])
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def difference(spark_df, con, sql: str) -> str | None:
    """None where both sides agree on columns, rows and values."""
    ours = pd.DataFrame([tuple(r) for r in spark_df.collect()], columns=spark_df.columns, dtype=object)
    cursor = con.execute(sql)
    theirs = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = _canonical(ours), _canonical(theirs)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        i = wrong.idxmax()
        return f"{int(wrong.sum())} rows differ, first: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None
