"""Run a query and its checking SQL on the same tables and compare."""

from __future__ import annotations

import math

import duckdb

from netweave.sources.tables import TABLES

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(found, con, sql: str) -> str | None:
    """None when columns, types and all values agree, else what differs."""
    cursor = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cursor.description}
    expected = _sorted_rows(list(described), cursor.fetchall())
    mine = dict(found.dtypes)
    if set(mine) != set(described):
        return f"columns {sorted(mine)} against {sorted(described)}"
    kinds = {c: (mine[c], KINDS.get(described[c], described[c])) for c in mine}
    wrong = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if wrong:
        return f"types {wrong}"
    rows = _sorted_rows(found.columns, [tuple(r) for r in found.collect()])
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    bad = [(a, b) for a, b in zip(rows, expected) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, such as {bad[0]}"
    return None
