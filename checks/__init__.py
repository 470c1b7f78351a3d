"""Queries over the given tables, each beside the SQL that DuckDB answers for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datadict.sources.fixtures import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a function of a `Catalog` under `name`."""

    def register(build: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
