"""Registry of named queries over the test tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use the derived views, which are put in front of it."""
    from postloom.plans.views import VIEWS_SQL

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            body = sql.strip()
            more = "," + body[4:] if body.lower().startswith("with ") else body
            ORACLES[name] = f"{VIEWS_SQL}{more}" if more.startswith(",") else f"{VIEWS_SQL}\n{more}"
        return function

    return register
