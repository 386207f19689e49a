"""Where the plan modules register their queries with the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its own name."""

    def add(plan: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return add


def r6(x: Column, name: str) -> Column:
    """Rounded to 6 places, as the SQL does."""
    return F.round(x, 6).alias(name)
