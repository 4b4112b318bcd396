"""Compare a query with its SQL, row by row, in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return c


def text(v):
    if v is None or v is pd.NA or v != v:
        return ""
    kind = type(v).__name__
    if "float" in kind or "Decimal" in kind:
        v = round(float(v), 6)
        return str(int(v)) if v.is_integer() else repr(v)  # pandas turns whole numbers into floats where some are null
    return str(int(v)) if "int" in kind else str(v)


def plain(df, columns):
    return sorted(tuple(text(v) for v in row) for row in df[columns].itertuples(index=False))


def assert_same(df, c, sql):
    got, want = df.toPandas(), c.execute(sql).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)
    return len(got)
