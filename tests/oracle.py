"""Runs a query and its SQL over the smallest tables, and compares them as sorted rows."""

import os

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def there() -> bool:
    return os.path.isdir(DATA)


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    return repr(round(float(v), 6)) if isinstance(v, float) or type(v).__name__.startswith(("float", "Decimal")) else str(v)


def same(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    made = query(spark, DATA)
    want = con.sql(sql)
    assert sorted(made.columns) == sorted(want.columns)
    cols = sorted(made.columns)
    rows = sorted([plain(r[c]) for c in cols] for r in made.collect())
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted([plain(r[i]) for i in at] for r in want.fetchall())
