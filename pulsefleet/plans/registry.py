"""Registry of the driver queries: a Spark callable and, where SQL can say it, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Queries whose values come from a trained model: no SQL can say them; tests check them by their meaning.
REPORTS: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def report(name: str):
    def register(fn: Query) -> Query:
        if name in QUERIES or name in REPORTS:
            raise ValueError(f"query {name} registered twice")
        REPORTS[name] = fn
        return fn

    return register
