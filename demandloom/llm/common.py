"""Helpers shared by the operators: tables, scratch storage, ranks over a whole table, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Later steps then read columns they need from storage that every executor sees, and a lost executor
    costs no recomputation of what came before.
    """
    spark = df.sparkSession
    place = f"{checkpoint_dir(spark).rstrip('/')}/demandloom-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def within(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than bound + 1 of them."""
    return df.limit(bound + 1).count() <= bound


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number the rows of ``df`` from 0 by ``order`` (which has no ties) without bringing them into one task.

    Rows are range-partitioned and numbered inside each range; one count per range is added up on the driver.
    """
    part, pos = f"__{name}_part", f"__{name}_pos"
    held = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in held.groupBy(part).count().collect())
    start, total = [], 0
    for p, n in counts:
        start += [F.lit(p), F.lit(total)]
        total += n
    offset = F.create_map(*start)[F.col(part)] if start else F.lit(0)
    numbered = held.withColumn(pos, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return numbered.withColumn(name, (offset + F.col(pos) - 1).cast("long")).drop(part, pos)


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of links(a, b): one row (id, component) per id in a link; component is its smallest id.

    Each round takes the smallest label among the neighbours and then follows the label's own label, so stars
    and chains shrink by halves. Labels live in storage; the driver sees one count a round.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(rounds):
        near = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m")))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        up = labels.select(F.col("id").alias("now"), F.col("component").alias("jump"))
        labels = cut(step.join(up, "now", "left").select("id", "was", F.least("now", F.coalesce("jump", "now")).alias("component")))
        done = labels.where("component <> was").limit(1).count() == 0
        labels = labels.select("id", "component")
        if done:
            return labels
    raise RuntimeError("connected components did not settle; raise ``rounds``")
