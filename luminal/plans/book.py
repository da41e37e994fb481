"""The collection of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from luminal.sources.records import load_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Registers f(*tables) under its name; its first table's session serves it."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(*load_tables(spark, folder, *tables))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero: trigonometric functions differ in their last bits between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
