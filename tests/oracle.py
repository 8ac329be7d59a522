"""Runs a query's oracle in DuckDB over the same tables and compares rows without order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(sql: str, folder: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c.execute(sql).df()


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, float) else v
    out = [tuple(clean(v.item() if hasattr(v, "item") else v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return [tuple(cols), *sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))]


def same(a, b) -> None:
    ra, rb = rows(a), rows(b)
    assert ra[0] == rb[0]
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) < 2e-5), (x, y)
