"""Named queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkmill.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(catalog)`` under a name, with its SQL if there is any."""

    def register(build: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Catalog(spark, folder))
        if sql:
            SQL[name] = sql
        return build

    return register
