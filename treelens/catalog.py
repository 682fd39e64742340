"""Registry of the queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treelens.plans import analogues, buildmap_queries, scan, structural_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (scan, analogues, buildmap_queries, structural_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
