"""Comparison of a query with its SQL twin in DuckDB."""

import glob
import os


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def rows(pdf, columns):
    return sorted(tuple(plain(v) for v in r) for r in pdf[columns].itertuples(index=False))
