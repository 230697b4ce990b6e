"""Runs a query and its SQL on one folder of tables and compares all rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings exchanges claude modern legacy fork files eval_items line_fields".split()


def _plain(x: object) -> object:
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[c]) for c in names) for r in df.select(*names).collect())


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def difference(df, sql: str, folder: str) -> str:
    """Empty if both give the same rows."""
    a, x = rows_of(df)
    b, y = rows_of_sql(sql, folder)
    if a != b:
        return f"columns {a} and {b}"
    if x == y:
        return ""
    return f"{sum(x.values())} and {sum(y.values())} rows; only Spark {list((x - y).elements())[:4]}; only SQL {list((y - x).elements())[:4]}"
