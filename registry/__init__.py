"""Queries of the driver contract: each with its Spark form and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query that takes (tables) and its SQL over the same tables."""
    def add(build: Callable) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            from registry.tables import Tables

            return build(Tables(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def load() -> None:
    from registry import (  # noqa: F401
        catalogue, entities, figures, files, imports, lifecycle, markets, reporting, scalars, snapshots,
        streams,
    )
