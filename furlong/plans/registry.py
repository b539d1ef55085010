"""Registered queries: a function (spark, sf_dir) -> DataFrame, and the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    """Register a query. oracle: SQL that may use the views of plans.views (base=True) as tables."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            from .views import SQL

            ORACLE[name] = f"{SQL}{oracle.strip()}" if base else oracle.strip()
        return f

    return add
