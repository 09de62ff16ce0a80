"""Compare a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value.is_integer() else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normal(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str, show: int = 3) -> str | None:
    """None when the results are equal, else a short description."""
    got_columns = df.columns
    got = normal(got_columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    want = normal(want_columns, result.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if got == want:
        return None
    missing, extra = [r for r in want if r not in set(got)], [r for r in got if r not in set(want)]
    return (f"{len(got)} rows against {len(want)}; {sorted(got_columns)}\n"
            f"  only SQL ({len(missing)}): {missing[:show]}\n  only Spark ({len(extra)}): {extra[:show]}")
