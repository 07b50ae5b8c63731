"""Collects queries with the SQL that must give the same rows."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.derived import Tables, with_views
from rowferry.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables` under its own name."""
    def add(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        run.__name__, run.__doc__ = key, fn.__doc__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = with_views(textwrap.dedent(sql))
        return fn
    return add
