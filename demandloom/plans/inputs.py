"""The planning tables every query starts from, derived lazily from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as FA
from ..sources import planning as P

YEARS = dict(start_year=1995, end_year=2001)


def sales(spark: SparkSession, path: str, **kw) -> DataFrame:
    return P.sales(spark, path, **kw)


def wl(spark: SparkSession, path: str) -> DataFrame:
    return FA.wholesale_long(P.wholesale_rows(spark, path))


def cal(spark: SparkSession, path: str) -> DataFrame:
    return P.calendar(spark)


def facts(spark: SparkSession, path: str, *, model_year: bool = False, lifecycle: bool = False) -> DataFrame:
    s = sales(spark, path, model_year=model_year)
    life = FA.lifecycle(sales(spark, path), cutoff_year=2000) if lifecycle else None
    return FA.monthly_facts(s, wl(spark, path), cal(spark, path), life, **YEARS)


def anchored_sales(spark: SparkSession, path: str) -> DataFrame:
    """Facts without ratios, calendar or vehicle join: enough for series and allocation work."""
    s = FA.clean_sales(sales(spark, path), **YEARS)
    g = s.groupBy("month", "brand", "model_key", "model_name", "plc", "part_number").agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"),
        F.mode("part_description", True).alias("part_description"))
    return FA.assign_anchor(g, FA.anchor_map(wl(spark, path)))
