"""Registry of named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeflow.plans.fixture_sql import with_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, tuple[list[str], str]] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None, tables: str = ""):
    """Register a query.

    ``covers`` lists the operator ids of the survey, ``tables`` the derived
    input tables the SQL text refers to.
    """
    def add(fn: QueryFn) -> QueryFn:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            _SQL[name] = (tables.split(), sql)
        return fn
    return add


def oracles() -> dict[str, str]:
    """Complete SQL text per query."""
    return {name: with_tables(tables, sql) for name, (tables, sql) in _SQL.items()}
