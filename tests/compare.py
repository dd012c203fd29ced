"""Run a driver query and its SQL twin and compare the two results."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def cell(value):
    if isinstance(value, Decimal):
        raise TypeError("decimal in a result; cast it")
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if value == 0 and math.copysign(1, value) < 0:
            raise ValueError("negative zero in a result")
        return value
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def normal(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in place]
    out = [tuple(cell(row[i]) for i in place) for row in rows]
    return names, sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def spark_rows(df):
    table = df.toArrow()
    return normal(table.column_names, [tuple(row.values()) for row in table.to_pylist()] if table.num_rows else [])


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return normal(columns, cursor.fetchall())


def difference(left, right):
    """None when equal, otherwise a short description."""
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return f"columns {lc} vs {rc}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} vs {len(rr)}"
    bad = [(a, b) for a, b in zip(lr, rr) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(lr)} rows differ; {lc}; first {bad[0][0]} vs {bad[0][1]}"
    return None
