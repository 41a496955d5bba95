"""Run a registered query and its SQL side by side and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, bytes)):
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value.asDict().values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(data, key=repr)


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and type(a) is not str and type(b) is not str and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def odd_types(con, sql) -> list[str]:
    """Result columns of a type that other readers turn into floats or text."""
    cur = con.execute(f"DESCRIBE {sql}")
    return [f"{r[0]}:{r[1]}" for r in cur.fetchall() if r[1] == "HUGEINT" or r[1].startswith("DECIMAL") or r[1].endswith("[]")]


def difference(df, con, sql, exact=False) -> str | None:
    """None when both engines give the same table; otherwise what differs first."""
    names, rows = table(df.columns, df.collect())
    cur = con.execute(sql)
    o_names, o_rows = table([c[0] for c in cur.description], cur.fetchall())
    if names != o_names:
        return f"columns {names} != {o_names}"
    if len(rows) != len(o_rows):
        return f"rows {len(rows)} != {len(o_rows)}; {rows[:1]} | {o_rows[:1]}"
    for a, b in zip(rows, o_rows):
        if a != b if exact else not same(a, b):
            return f"first difference {dict(zip(names, a))} != {dict(zip(names, b))}"
    return None
