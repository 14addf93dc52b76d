"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.sources.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; sql is its DuckDB text."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return put
