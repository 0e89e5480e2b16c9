"""Runs a query and its SQL twin on the same tables and compares columns and rows, whatever their order."""

import math
from pathlib import Path

import duckdb


def tables(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{round(float(value), 6) + 0.0:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """None where both agree, else a short account."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return None
