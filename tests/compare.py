"""Run a registered query and its SQL counterpart and compare whole results."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def open_tables(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    return str(value)


def _shape(kind: str) -> str:
    kind = kind.lower()
    names = {
        "bigint": "long", "integer": "int", "varchar": "string", "timestamp_ntz": "timestamp",
        "hugeint": "hugeint",
    }
    return names.get(kind, kind).replace(" ", "")


def compare(df, connection, sql: str) -> dict:
    spark_rows = df.collect()
    cursor = connection.execute(sql)
    described = {d[0]: _shape(str(d[1])) for d in cursor.description}
    names = sorted(described)
    duck = [dict(zip([d[0] for d in cursor.description], row)) for row in cursor.fetchall()]
    kinds = {f.name: _shape(f.dataType.simpleString().replace("bigint", "long")) for f in df.schema.fields}
    left = sorted(tuple(_cell(r[n]) for n in names) for r in spark_rows) if set(kinds) == set(names) else None
    right = sorted(tuple(_cell(r[n]) for n in names) for r in duck)
    return {
        "rows": len(spark_rows),
        "expected": len(duck),
        "columns": set(kinds) == set(names),
        "values": left == right,
        "types": {n: (kinds.get(n), described[n]) for n in names if kinds.get(n) != described[n]},
        "first_difference": None if left == right or left is None else next(
            ((a, b) for a, b in zip(left, right) if a != b), None
        ),
    }
