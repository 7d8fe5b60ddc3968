"""The engine's queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a table reader; its SQL holds it to account."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE[key] = sql
        return f

    return register
