"""Catalogue of runnable queries over the given tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .base_sql import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register fn(spark, path) under name; ``oracle`` is the same result in plain SQL."""
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = sql(oracle)
        return fn
    return add
