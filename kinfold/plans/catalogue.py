"""Queries for the linkage operators, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.plans import context, decisions, keys, measures, resolution, retrieval, scoring, stores, truth

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retrieval, context, decisions, resolution, truth, keys, scoring, stores, measures)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
