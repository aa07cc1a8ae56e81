"""Named queries, each with the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query. views: names of adapter views that the SQL uses, put before it."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            head = cte(*views.split()) if views else ""
            if text.lower().startswith("with "):
                text = f"with {head}, {text[5:]}" if head else text
            elif head:
                text = f"with {head} {text}"
            SQL[name] = text
        return f

    return add
