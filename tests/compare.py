"""Compare registered queries with their SQL twins the way the driver does."""

from __future__ import annotations

import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted([tuple("~" if pd.isna(v) else (repr(float(v)) if isinstance(v, float) else str(v))
                         for v in r) for r in pdf.itertuples(index=False, name=None)])


def compare(spark, con, name, query, sql, folder):
    """(message or None, seconds, number of rows)."""
    t = time.time()
    got = query(spark, folder).toPandas()
    took = time.time() - t
    if sql is None:
        return None, took, len(got)
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}", took, len(got)
    for c in want.columns:  # a missing value turns whole numbers into floats on one side only
        if got[c].dtype != want[c].dtype and "float64" in (str(got[c].dtype), str(want[c].dtype)):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    a, b = rows(got), rows(want)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} rows / {len(b)} rows; {odd}", took, len(got)
    return None, took, len(got)
