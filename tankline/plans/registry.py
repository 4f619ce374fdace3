"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

import inspect
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from . import oracle, oracle_names, oracle_pages, queries, scans


def _of(module: ModuleType) -> dict:
    return {n: f for n, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not n.startswith("_") and n != "rounded"}


QUERIES = _of(queries) | _of(scans)

ORACLE_SQL = oracle.ORACLE_SQL | oracle_names.ORACLE_SQL | oracle_pages.ORACLE_SQL | scans.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.route_cost_register(spark, sf_dir)
