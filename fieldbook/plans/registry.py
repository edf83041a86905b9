"""Queries by name, each with the SQL that answers the same question elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its name; sql is its oracle."""

    def put(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return put


def rounded_sql(x: str, places: int = 4) -> str:
    """Half up, by way of a decimal, so that engines agree."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {places}) AS DOUBLE)"
