"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from civic_spark.bindings.views import BASE_TABLES

SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        value = value.date()
    return repr(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str, types: bool = True) -> tuple[int, list[str]]:
    """Row count and a list of differences, empty when the two agree."""
    mine = rows_of(df.columns, df.collect())
    result = con.sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(result.columns):
        problems.append(f"columns {sorted(df.columns)} / {sorted(result.columns)}")
    if types and not problems:
        wanted = dict(zip(result.columns, [str(t) for t in result.types]))
        for field in df.schema.fields:
            name = SPARK_TO_DUCK.get(field.dataType.simpleString(), field.dataType.simpleString())
            if name != wanted[field.name]:
                problems.append(f"type of {field.name}: {name} / {wanted[field.name]}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} / {len(theirs)}")
    if mine != theirs:
        a, b = set(mine), set(theirs)
        problems.append(f"only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}; {len(a - b)}/{len(b - a)}")
    return len(mine), problems
