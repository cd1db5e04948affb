"""Registry of queries, each with the SQL that gives the same table, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = (), name: str | None = None):
    """Register a query; `needs` names the common tables its SQL builds on."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = with_tables(sql, needs)
        return fn

    return register


def table(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """Name a common table for the SQL side."""
    CTES[name] = (needs, sql)


def with_tables(sql: str, needs: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n.split("(")[0] in order:
            return
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return sql
    parts = [f"{n} AS {CTES[n][1]}" if CTES[n][1].startswith("(") else f"{n} AS MATERIALIZED (\n{CTES[n][1]}\n)" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The table with the named columns rounded to 6 places."""
    return df.withColumns({c: r6(c) for c in columns})
