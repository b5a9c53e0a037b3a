"""Adapter from order-line style tables to the planning schema.

Each reader selects only the columns it needs, so parquet reads stay narrow, and joins
``orders`` only when an attribute of the order is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

ANCHOR_BY_REMAINDER = ("HMA", "GMA", "KUS")   # brand number modulo 3
LETTER_BY_REMAINDER = ("H", "G", "K")


#: Rows of a table that Spark may send whole to every task of a join.
SENT_ROWS = 250_000


def table(spark: SparkSession, path: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}.parquet")
    return df.select(*columns) if columns else df


def beside(side: DataFrame, read: DataFrame) -> DataFrame:
    """``side``, made of the rows of table ``read``, for a join: sorted and merged where that table has many rows.

    Spark sends a side to every task by the size of its files, and compressed files tell little of what the rows take in the
    driver's memory. Rows are counted in the files' footers.
    """
    return side.hint("merge") if read.count() > SENT_ROWS else side


def _by_remainder(code, values):
    n = F.regexp_extract(code, r"(\d+)", 1).cast("int") % 3
    return F.when(n == 0, values[0]).when(n == 1, values[1]).otherwise(values[2])


def _parts(spark, path):
    p = table(spark, path, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return beside(p.select(
        "p_partkey",
        _by_remainder(F.col("p_brand"), LETTER_BY_REMAINDER).alias("brand"),
        F.col("p_name").alias("model_name"),
        F.col("p_brand").alias("model_code"),
        F.col("p_type").alias("plc"),
        F.col("p_partkey").cast("string").alias("part_number"),
        F.concat_ws(" ", "p_name", "p_type").alias("part_description"),
    ), p)


def sales(spark: SparkSession, path: str, *, model_year: bool = False) -> DataFrame:
    """One row per sale line. ``model_year=True`` adds the join to the orders table."""
    lines = table(spark, path, "lineitem", *(
        ["l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"]
        + (["l_orderkey"] if model_year else [])))
    lines = lines.withColumn(
        "revenue", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    ).withColumn("sale_date", F.to_date("l_shipdate")).drop("l_extendedprice", "l_discount", "l_shipdate")
    out = lines.join(_parts(spark, path), F.col("l_partkey") == F.col("p_partkey"))
    year = F.lit("")
    if model_year:
        orders = table(spark, path, "orders", "o_orderkey", "o_orderdate")
        orders = beside(orders.select("o_orderkey", F.year("o_orderdate").cast("string").alias("model_year")), orders)
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        year = F.coalesce("model_year", F.lit(""))
    return out.select(
        "sale_date", "brand", "model_name", "model_code", year.alias("model_year"), "part_number",
        "part_description", "plc", F.col("l_quantity").alias("quantity"), "revenue")


def wholesale_rows(spark: SparkSession, path: str) -> DataFrame:
    """Vehicle volumes at month x brand label x model x code x channel."""
    lines = table(spark, path, "lineitem", "l_orderkey", "l_partkey", "l_linestatus")
    orders = table(spark, path, "orders", "o_orderkey", "o_orderdate")
    orders = beside(orders.select("o_orderkey", D.month_of("o_orderdate").alias("month")), orders)
    parts = table(spark, path, "part", "p_partkey", "p_name", "p_brand")
    parts = beside(parts.select("p_partkey", F.col("p_name").alias("model_name"), F.col("p_brand").alias("model_code"),
                                _by_remainder(F.col("p_brand"), ANCHOR_BY_REMAINDER).alias("brand")), parts)
    j = (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
         .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    channel = F.when(F.col("l_linestatus") == "F", "fleet").otherwise("wholesale")
    return (j.groupBy("month", "brand", "model_name", "model_code", channel.alias("channel"))
            .agg(F.count_distinct("l_orderkey").cast("double").alias("units")))


def calendar(spark: SparkSession, first: str = "1994-01", last: str = "2003-12") -> DataFrame:
    """month -> weekdays in the month. A dimension of at most a few hundred rows."""
    months = spark.range(1).select(F.explode(F.sequence(
        F.lit(f"{first}-01").cast("date"), F.lit(f"{last}-01").cast("date"),
        F.expr("interval 1 month"))).alias("d"))
    return months.select(D.month_of("d").alias("month"),
                         D.weekdays(F.col("d"), F.last_day("d")).cast("double").alias("working_days"))
