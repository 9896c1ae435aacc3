"""Side-by-side run of a Spark query and its DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def table(columns, rows):
    """Rows with columns sorted by name, sorted by their text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def from_spark(df):
    return table(df.columns, df.collect())


def from_duckdb(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def difference(a, b) -> str | None:
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} / {len(b[1])}"
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first: {wrong[0]}"
    kinds = [
        (c, type(x), type(y)) for c, x, y in zip(a[0], *(a[1][:1] + b[1][:1])) if type(x) != type(y)
    ] if a[1] else []
    return f"types {kinds}" if kinds else None
