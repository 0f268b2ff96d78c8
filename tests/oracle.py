"""Compare a query with its oracle on the driver's tables."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differences(spark, query, sql, folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want, got = con.sql(sql).df(), query(spark, folder).toPandas()
    columns = sorted(want.columns)
    if sorted(got.columns) != columns or len(got) != len(want):
        return {"columns": (sorted(got.columns), columns), "rows": (len(got), len(want))}
    keys = [c for c in columns if want[c].dtype.kind != "f"] or columns
    got, want = (x[columns].sort_values(keys).reset_index(drop=True) for x in (got, want))
    out = {}
    for c in columns:
        a, b = got[c], want[c]
        if a.dtype.kind in "fi" or b.dtype.kind in "fi":
            a, b = pd.to_numeric(a).astype(float), pd.to_numeric(b).astype(float)
        if not ((a == b) | (a.isna() & b.isna())).all():
            out[c] = int((~((a == b) | (a.isna() & b.isna()))).sum())
    return out
