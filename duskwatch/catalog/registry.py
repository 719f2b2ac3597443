"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.catalog.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with its SQL if it has one."""

    def keep(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


def newest(spark: SparkSession, sf_dir: str) -> datetime:
    """The largest event time. Fetched first, so look-backs prune the scan as literals."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def rounded(column: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Round for comparison; adding zero drops the sign of a negative zero."""
    value = F.col(column) if isinstance(column, str) else column
    return (F.round(value, digits) + F.lit(0.0)).alias(name or column)
