"""Examples for learned challengers: leakage-safe features, predictions of anchor and alternatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestContract
from ..functions import dates as D
from ..functions import forecast as FC
from . import evaluate as EV

ALTERNATIVES = ("naive_last", "seasonal_naive", "trailing_12_mean")
ANCHOR_WEIGHTS = (0.7, 0.8, 0.9)                          # fixed value
BASE = ["log_anchor", "log_lag1", "log_lag2", "log_lag3", "log_lag12", "log_rolling3", "log_rolling6", "trend6", "volatility6", "seasonal_ratio",
        "zero_share12", "working_day_ratio", "working_days_scaled"]


def synchronized(packed: DataFrame) -> DataFrame:
    """Check column ``in_range``: every series covers the same months."""
    span = packed.agg(F.min("start_ord").alias("lo"), F.max(F.col("start_ord") + F.col("n") - 1).alias("hi"))     # one row
    ok = (F.col("start_ord") == F.col("lo")) & (F.col("start_ord") + F.col("n") - 1 == F.col("hi"))
    return packed.crossJoin(F.broadcast(span)).withColumn("in_range", ok).drop("lo", "hi")


def examples(packed: DataFrame, cal_row: DataFrame, anchor: Column, entities: tuple[str, ...], contract: BacktestContract = BacktestContract(),
             next_only: bool = False) -> DataFrame:
    """One row per (entity, origin, horizon): features known at the origin, anchor and alternative
    predictions, actual. ``anchor`` names the reference method per row. With ``next_only`` the only origin
    is the end of the history, and actuals are null."""
    top = max(contract.horizons)
    p = packed.crossJoin(F.broadcast(cal_row)).withColumn("anchor_method", anchor)

    def one(o):
        def body(h):
            lag = lambda k: F.when(F.size(h) >= k, FC.back(h, k)).otherwise(F.get(h, 0))
            logs = F.transform(FC.tail(h, 6), lambda x: F.log1p(x))

            def slope(y):
                xm = (F.size(y) - 1) / 2.0
                den = FC.asum(F.transform(y, lambda v, i: (i - xm) * (i - xm)))
                return F.coalesce(FC.asum(F.transform(y, lambda v, i: v * (i - xm))) / F.nullif(den, F.lit(0.0)), F.lit(0.0))
            ratio = F.greatest(F.lit(0.0), F.least(lag(1) / F.greatest(lag(12), F.lit(1.0)), F.lit(5.0)))
            last12 = FC.tail(h, 12)
            return F.struct(o.alias("o"), F.log1p(lag(1)).alias("log_lag1"), F.log1p(lag(2)).alias("log_lag2"), F.log1p(lag(3)).alias("log_lag3"),
                            F.log1p(lag(12)).alias("log_lag12"), F.log1p(FC.amean(FC.tail(h, 3))).alias("log_rolling3"), F.log1p(FC.amean(FC.tail(h, 6))).alias("log_rolling6"),
                            F.greatest(F.lit(-1.0), F.least(FC.let(logs, slope), F.lit(1.0))).alias("trend6"), FC.pop_std(logs).alias("volatility6"), ratio.alias("seasonal_ratio"),
                            (F.size(F.filter(last12, lambda x: x <= 0)) / F.size(last12)).alias("zero_share12"),
                            FC.path_by_name(h, F.col("anchor_method"), top).alias("pa"), *[FC.path(h, m, top).alias(m) for m in ALTERNATIVES],
                            (F.array_repeat(F.lit(None).cast("double"), top) if next_only else F.slice("h", o + 1, top)).alias("act"))
        return FC.let(F.slice("h", 1, o), body)
    origins = F.array(F.size("h")) if next_only else F.sequence(F.lit(contract.minimum_training_months), F.size("h") - 1)
    e = p.filter(F.size("h") > contract.minimum_training_months).select("entity", "start_ord", "days", F.explode(F.transform(origins, one)).alias("x")).select("entity", "start_ord", "days", "x.*")
    e = e.select("*", F.posexplode("act").alias("i", "actual")).filter((F.col("i") + 1).isin(*contract.horizons))
    target = F.col("start_ord") + F.col("o") + F.col("i")
    w, w12 = F.coalesce(F.try_element_at("days", target), F.lit(0.0)), F.coalesce(F.try_element_at("days", target - 12), F.lit(0.0))
    wr = F.greatest(F.lit(0.5), F.least(F.when((w > 0) & (w12 > 0), w / F.nullif(w12, F.lit(0.0))).otherwise(1.0), F.lit(1.5)))
    angle = (target % 12) * (2 * np.pi / 12)
    at = lambda c: F.greatest(F.get(c, F.col("i")), F.lit(0.0))
    e = e.withColumns({"anchor": at("pa"), **{f"p_{m}": at(m) for m in ALTERNATIVES}, "log_anchor": F.log1p(at("pa")), "working_day_ratio": wr,
                       "working_days_scaled": w / 23.0, "sin": F.sin(angle), "cos": F.cos(angle), "horizon_scaled": (F.col("i") + 1) / 3.0})
    first, second, third = entities
    is_ = lambda x: F.when(F.col("entity") == x, 1.0).otherwise(0.0)
    extra = {"is_b": is_(second), "is_c": is_(third), "c_working_day": is_(third) * F.col("working_day_ratio"), "c_seasonal": is_(third) * F.col("seasonal_ratio"),
             "a_trend": is_(first) * F.col("trend6")}
    for tag, ent in zip("abc", entities, strict=True):
        extra |= {f"{tag}_sin": is_(ent) * F.col("sin"), f"{tag}_cos": is_(ent) * F.col("cos"), f"{tag}_horizon": is_(ent) * F.col("horizon_scaled")}
    origin = F.col("start_ord") + F.col("o") - 1
    return e.withColumns(extra).select(
        "entity", D.month_from_ord(origin).alias("origin_month"), D.month_from_ord(target).alias("target_month"), (F.col("i") + 1).alias("horizon"), "actual", "anchor",
        *[f"p_{m}" for m in ALTERNATIVES], *BASE, *extra, (F.log1p("actual") - F.log1p("anchor")).alias("residual"))


def feature_names() -> list[str]:
    return BASE + ["is_b", "is_c", "c_working_day", "c_seasonal", "a_trend"] + [f"{t}_{k}" for t in "abc" for k in ("sin", "cos", "horizon")]


def improvements(ex: DataFrame) -> DataFrame:
    """How much closer than the anchor each alternative is, per example."""
    base = F.abs(F.col("actual") - F.col("anchor"))
    return ex.withColumns({f"gain_{m}": base - F.abs(F.col("actual") - F.col(f"p_{m}")) for m in ALTERNATIVES})


def entity_backtest(rows: DataFrame, last: int = 6) -> DataFrame:
    """Stored fold rows of the last one-month-ahead origins per entity, summarized."""
    w = Window.partitionBy("entity").orderBy(F.desc("target_month"))
    h1 = rows.filter("horizon = 1").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= last)
    return EV.summarize(h1, ["entity"])
