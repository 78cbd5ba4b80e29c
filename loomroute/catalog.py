"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _filled() -> None:
    from loomroute.plans import registry  # noqa: F401  the modules there register themselves


def queries() -> dict:
    _filled()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _filled()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _filled()
    return QUERIES["main_table_by_arm"](spark, sf_dir)
