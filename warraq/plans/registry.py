"""Queries by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL it is compared with, if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v}::double"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def stated(columns: str, rows: Sequence[tuple]) -> str:
    """SQL of rows stated by hand: what an operator is to give on inputs that no table holds."""
    quoted = ", ".join(f'"{c.strip()}"' for c in columns.split(","))
    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({quoted})"


def golden(columns: str, rows: Sequence[tuple]) -> Callable[[Callable[[SparkSession], DataFrame]], Query]:
    """Register a query on inputs of its own, with the rows that are to come out; it reads no table."""

    def register(f: Callable[[SparkSession], DataFrame]) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(stated(columns, rows))(run)

    return register
