"""Compares a Spark result with the same rows from SQL: columns by name, rows in any order."""

from __future__ import annotations

import math

import duckdb

#: The tables that tests use.
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x) if hasattr(x, "isoformat") else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str:
    """What differs, or an empty text."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want, have = rows_of(names, rel.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(want) != len(have):
        return f"{len(have)} rows and {len(want)}: {have[:2]} {want[:2]}"
    return next((f"{a} and {b}" for a, b in zip(have, want) if a != b), "")
