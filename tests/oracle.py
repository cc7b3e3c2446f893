"""Compare a query with its SQL: same columns, same bag of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, bool) or value is None:
        return value
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, fn, sql, folder):
    """None when equal, else a short description."""
    df = fn(spark, folder)
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows"
    rel = db.sql(sql)
    theirs = bag(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    if mine != theirs:
        gap = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
        return f"rows {len(mine)} / {len(theirs)}, first difference {str(gap)[:600]}"
    ours = {c: t for c, t in df.dtypes}
    for name, kind in zip(rel.columns, map(str, rel.types)):
        wide = kind in ("HUGEINT",) or kind.startswith("DECIMAL")
        if wide:
            return f"column {name} is {kind} in SQL, {ours[name]} here"
    return None
