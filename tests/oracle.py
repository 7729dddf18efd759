"""Compares a registered query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    # 0.0 and -0.0 are one value, and so are 1 and 1.0
    return [columns[i] for i in order], sorted((tuple(float(r[i]) + 0.0 if isinstance(r[i], (int, float)) else r[i] for i in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    mine, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), connection(sf_dir).execute(sql)
    other = rows_of([x[0] for x in theirs.description], theirs.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} and {other[0]}"
    if mine[1] != other[1]:
        a, b = set(mine[1]), set(other[1])
        return f"{len(mine[1])} and {len(other[1])} rows; only here {sorted(a - b, key=repr)[:2]}, only there {sorted(b - a, key=repr)[:2]}"
    return ""
