"""Run registered queries and their SQL on the same tables and compare every value."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb

# Spark type names by the DuckDB type of the matching column.
TYPES = {
    "VARCHAR": "string", "DOUBLE": "double", "BIGINT": "bigint", "INTEGER": "int", "DATE": "date",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sortable(row: tuple) -> tuple:
    plain = (v.isoformat() if isinstance(v, dt.date) else v for v in row)
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in plain)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty when they agree."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {name: TYPES.get(kind, kind) for name, kind, *_ in described}
    ours = dict(df.dtypes)
    if ours != theirs:
        return [f"schema: {sorted(set(ours.items()) ^ set(theirs.items()))}"]
    names = sorted(ours)
    left = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_sortable)
    columns = ", ".join(f'"{n}"' for n in names)
    right = sorted(con.execute(f"SELECT {columns} FROM ({sql})").fetchall(), key=_sortable)
    if len(left) != len(right):
        return [f"rows: {len(left)} and {len(right)}"]
    return [f"{a} and {b}" for a, b in zip(left, right) if a != b]
