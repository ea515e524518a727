"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def _load() -> None:
    """Imports the modules that register queries."""
    from lumenframe.plans import aggregates, changes, documents, extracts, files, joins, library, lookups, moments, named, scalars  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["T04_vector_search"](spark, sf_dir)
