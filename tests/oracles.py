"""Rows of a query and of its SQL, made alike for comparison."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def differ(df, con, sql: str) -> str:
    """What is different, or nothing."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows_of(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(have) != len(want):
        return f"{len(have)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(bad)} of {len(have)} rows, such as {bad[0]}" if bad else ""
