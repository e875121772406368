"""Queries by name and, where SQL can express them, the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Adds the decorated query under its own name, with the SQL that it must equal."""

    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


from tallyshelf.plans import catalogue, comments, exports, jobs, payloads, readings, shelf, store, texts  # noqa: E402,F401  (they register their queries)
