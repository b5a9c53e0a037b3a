"""The forecast center: one cube of actuals, the open month and the forecast over all levels of a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = ["brand", "entity_key", "model_name", "plc"]
#: Level -> its keys; what a level lacks is empty in its rows.
LEVELS = {"total": [], "brand": ["brand"], "model": ["brand", "entity_key", "model_name"], "plc": ["plc"], "model_plc": LEAF}


def _level_code(keys: list[str]) -> int:
    return sum(1 << (len(LEAF) - 1 - i) for i, k in enumerate(LEAF) if k not in keys)


def cube(actual: DataFrame, allocated: DataFrame, now: DataFrame, bounds: DataFrame) -> DataFrame:
    """(surface, level, brand, entity_key, model_name, plc, month, value, lower, upper, validated, leaves).

    actual, allocated: (LEAF, month, value), of past months and of the forecast. now: (brand, month, baseline, value, forecast_type),
    the forecast of each brand and what it becomes once the open month's sales are known. bounds: (brand, month, lower, upper, status).

    A leaf keeps its share of its brand: it follows the nowcast, and takes its part of the brand's bounds, which never cut into its
    value. Sums over leaves then give every level in one pass, and a level's bounds add up to those of the level above. A cell is
    validated when the bounds of all its leaves are. Leaves of a brand without a forecast row are left as they are, unvalidated.
    """
    info = now.select("brand", "month", "baseline", F.col("value").alias("nv"), "forecast_type").join(bounds, ["brand", "month"], "left")
    j = allocated.select(*LEAF, "month", F.col("value").alias("v")).join(F.broadcast(info), ["brand", "month"], "left")          # a row for a brand and month
    v = F.when(F.col("nv").isNull(), F.col("v")).otherwise(F.col("v") * F.when(F.col("baseline") > 0, F.col("nv") / F.col("baseline")).otherwise(0.0))
    j = j.withColumn("value", v).withColumn("ratio", F.when(F.col("nv") > 0, F.col("value") / F.col("nv")).otherwise(0.0))
    low = F.when(F.col("lower").isNull(), F.col("value")).otherwise(F.least("value", F.greatest(F.lit(0.0), F.col("lower") * F.col("ratio"))))
    high = F.when(F.col("upper").isNull(), F.col("value")).otherwise(F.greatest("value", F.col("upper") * F.col("ratio")))
    ahead = j.select(F.lower(F.coalesce("forecast_type", F.lit("Forecast"))).alias("surface"), *LEAF, "month", "value", low.alias("lower"), high.alias("upper"),
                     F.coalesce(F.col("status") == "validated", F.lit(False)).alias("validated"))
    none = F.lit(None)
    past = actual.select(F.lit("actual").alias("surface"), *LEAF, "month", F.col("value").cast("double").alias("value"), none.cast("double").alias("lower"),
                         none.cast("double").alias("upper"), none.cast("boolean").alias("validated"))
    sets = [tuple(["surface", "month", *keys]) for keys in LEVELS.values()]
    code = F.grouping_id("surface", "month", *LEAF)
    level = F.coalesce(*[F.when(F.col("code") == _level_code(keys), F.lit(name)) for name, keys in LEVELS.items()])
    out = past.unionByName(ahead).groupingSets(sets, "surface", "month", *LEAF).agg(
        code.alias("code"), F.sum("value").alias("value"), F.sum("lower").alias("lower"), F.sum("upper").alias("upper"),
        F.bool_and("validated").alias("validated"), F.count(F.lit(1)).alias("leaves"))
    return out.select("surface", level.alias("level"), *[F.coalesce(c, F.lit("")).alias(c) for c in LEAF], "month", "value", "lower", "upper", "validated", "leaves")
