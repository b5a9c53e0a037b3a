"""Comparisons over published planning records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FLEET = "kia_fleet_cfm_adjustment"      # fixed value of the fleet component
KEYS = ["brand", "plc"]


def grouped(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.sum("revenue").alias("revenue"))


def landing_rows(records: DataFrame) -> DataFrame:
    """Per month the nowcast rows when there are any, else the forecast rows."""
    kind = F.when(F.col("record_type").startswith("nowcast_"), 1).when(F.col("record_type").startswith("forecast_"), 0)
    r = records.withColumn("kind", kind).filter("kind is not null")
    best = r.groupBy("month").agg(F.max("kind").alias("best"))
    return r.join(F.broadcast(best), "month").filter("kind = best").drop("kind", "best")     # one row per month


def rank_changes(base: DataFrame, target: DataFrame, by: list[str], top: int | None = 5) -> DataFrame:
    """Matched pairs by change; the largest per comparison and direction with rank.

    ``by`` are the comparison columns present on both sides next to brand and plc.
    """
    b = base.groupBy(*by, *KEYS).agg(F.sum("revenue").alias("comparison_revenue"))
    t = target.groupBy(*by, *KEYS).agg(F.sum("revenue").alias("target_revenue"))
    j = b.join(t, by + KEYS).withColumn("change", F.col("target_revenue") - F.col("comparison_revenue")).filter(F.abs("change") > 1e-9)
    j = j.withColumn("direction", F.when(F.col("change") > 0, "upside").otherwise("downside"))
    j = j.withColumn("change_pct", F.when(F.col("comparison_revenue") > 0, F.col("change") / F.col("comparison_revenue")))
    w = Window.partitionBy(*by, "direction").orderBy(F.desc(F.abs("change")), *KEYS)
    j = j.withColumn("rank", F.row_number().over(w))
    return j.filter(F.col("rank") <= top) if top else j


def adjacent_pairs(months: DataFrame) -> DataFrame:
    """Each month with the month before it in the list (one row per month)."""
    return (months.select("month").distinct().select(F.lag("month").over(Window.orderBy("month")).alias("comparison_month"),
                                                     F.col("month").alias("target_month")).filter("comparison_month is not null"))


def _sides(points: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = grouped(points, KEYS + ["month"])
    p = F.broadcast(pairs)                                   # one row per month
    return (g.join(p, g["month"] == p["comparison_month"]).drop("month"), g.join(p, g["month"] == p["target_month"]).drop("month"))


def actual_movers(actuals: DataFrame, top: int = 5) -> DataFrame:
    return rank_changes(*_sides(actuals, adjacent_pairs(actuals)), ["comparison_month", "target_month"], top)


def bridge_movers(actuals: DataFrame, plan: DataFrame, latest_complete: str, top: int = 5) -> DataFrame:
    """Last complete month against the first plan month after it, components combined."""
    first = plan.filter(F.col("month") > latest_complete).agg(F.min("month").alias("m"))
    t = plan.join(F.broadcast(first), F.col("month") == F.col("m")).select(*KEYS, "revenue", F.col("m").alias("target_month"))
    b = actuals.filter(F.col("month") == latest_complete).crossJoin(F.broadcast(first)).select(*KEYS, "revenue", F.col("m").alias("target_month"))
    return rank_changes(b, t, ["target_month"], top)


def forecast_movers(plan: DataFrame, top: int = 5) -> DataFrame:
    return actual_movers(plan, top)


def comparison_counts(plan: DataFrame) -> DataFrame:
    """Matched, unmatched, unchanged and non-positive-base pairs per adjacent plan comparison."""
    b, t = _sides(plan, adjacent_pairs(plan))
    by = ["comparison_month", "target_month"] + KEYS
    j = b.withColumnRenamed("revenue", "b").join(t.withColumnRenamed("revenue", "t"), by, "full_outer")
    both, ch = F.col("b").isNotNull() & F.col("t").isNotNull(), F.col("t") - F.col("b")
    return j.groupBy("comparison_month", "target_month").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(both).alias("matched"), F.count_if(~both).alias("unmatched"),
        F.count_if(both & (ch > 1e-9)).alias("upside"), F.count_if(both & (ch < -1e-9)).alias("downside"),
        F.count_if(both & (F.abs(ch) <= 1e-9)).alias("zero_change"), F.count_if(both & (F.col("b") <= 0)).alias("nonpositive_base"))


def overview_movers(movers: DataFrame, by: list[str], limit: int = 5) -> DataFrame:
    """The largest absolute moves of both directions; the upside wins a tie."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("change")), F.desc("direction"), "rank")
    return movers.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def ranked_plcs(rows: DataFrame, month: str, top: int = 6) -> DataFrame:
    """Largest PLCs of a month, stacked by brand with the fleet component shown apart."""
    r = rows.filter(F.col("month") == month).withColumn("stack", F.when(F.col("component") == FLEET, "Fleet").otherwise(F.col("brand")))
    keep = r.groupBy("plc").agg(F.sum("revenue").alias("total")).orderBy(F.desc("total"), "plc").limit(top)
    return r.join(F.broadcast(keep), "plc").groupBy("plc", "total", "stack").agg(F.sum("revenue").alias("revenue"))   # top rows


def ranked_models(rows: DataFrame, month: str, top: int = 6) -> DataFrame:
    return (rows.filter((F.col("month") == month) & (F.coalesce("component", F.lit("")) != FLEET)).groupBy("brand", "model_name")
            .agg(F.sum("revenue").alias("revenue")).orderBy(F.desc("revenue"), "brand", "model_name").limit(top))


def planning_months(actuals: DataFrame, plan: DataFrame, data_through: str) -> DataFrame:
    """All months with their period label."""
    a = actuals.select("month").distinct().withColumn("seen", F.lit(True))
    m = actuals.select("month").union(plan.select("month")).distinct().join(a, "month", "left")
    return m.select("month", F.when(F.col("seen"), "actual").when(F.col("month") == data_through[:7], "original_forecast").otherwise("forecast").alias("period"))


def wholesale_summary(records: DataFrame, brands: DataFrame) -> DataFrame:
    """Per month and brand the selected, plan and internal figures; totals only when all are present."""
    months = records.select("month").distinct()
    j = months.crossJoin(F.broadcast(brands)).join(records, ["month", "brand"], "left")       # months x three brands
    sel = T.first_finite(F.col("selected"), F.col("forecast_wholesale"))
    j = j.select("month", "brand", sel.alias("selected"), "sponsor_plan", "internal", T.wholesale_source_label(F.col("source")).alias("source"), "fallback_models")
    tot = j.groupBy("month").agg(F.when(F.bool_and(F.col("selected").isNotNull()), F.sum("selected")).alias("total_selected"),
                                 F.when(F.bool_and(F.col("fallback_models").isNotNull()), F.count_if(F.col("fallback_models") > 0)).alias("brands_using_fallback"))
    return j.join(F.broadcast(tot), "month")                                                  # one row per month


def revenue_trend(records: DataFrame, current_month: str, months: int = 6) -> DataFrame:
    """First six plan months of the total; the open month shows its nowcast; first three are primary."""
    f = records.filter("record_type = 'forecast_total'").groupBy("month").agg(F.sum("revenue").alias("f"))
    n = records.filter((F.col("record_type") == "nowcast_total") & (F.col("month") == current_month)).groupBy("month").agg(F.sum("revenue").alias("n"))
    t = f.orderBy("month").limit(months).join(n, "month", "left").withColumn("k", F.row_number().over(Window.orderBy("month")))
    return t.select("month", F.coalesce("n", "f").alias("value"), F.when(F.col("n").isNotNull(), "nowcast").otherwise("forecast").alias("period_type"),
                    F.when(F.col("k") <= 3, "Primary").otherwise("Exploratory").alias("horizon"))


def brand_trend(points: DataFrame, brands: tuple[str, ...]) -> DataFrame:
    return points.groupBy("month", "period_type").pivot("brand", list(brands)).agg(F.sum("revenue")).withColumn(
        "total", reduce(lambda a, b: a + b, [F.coalesce(F.col(b), F.lit(0.0)) for b in brands]))


def brand_snapshots(actuals: DataFrame, landing: DataFrame, current: str, previous: str, following: str) -> DataFrame:
    """Current, previous, change and next value per brand."""
    at = lambda df, m, name: df.filter(F.col("month") == m).groupBy("brand").agg(F.sum("revenue").alias(name))
    j = at(landing, current, "current_value").join(at(actuals, previous, "previous_value"), "brand", "full_outer").join(
        at(landing, following, "next_value"), "brand", "full_outer")
    ch = F.col("current_value") - F.col("previous_value")
    return j.withColumn("change_value", ch).withColumn("change_pct", F.try_divide(ch, F.nullif(F.col("previous_value"), F.lit(0.0))))


def pnvw_history(actuals: DataFrame, nowcast: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """Revenue per vehicle of the last two actual months and the open month of the governed brands."""
    last2 = actuals.select("month").distinct().orderBy(F.desc("month")).limit(2)
    a = actuals.join(F.broadcast(last2), "month", "left_semi").withColumn("period_type", F.lit("actual"))
    n = nowcast.filter(F.col("brand").isin(*anchors)).withColumn("period_type", F.lit("nowcast"))
    u = a.unionByName(n).withColumn("pnvw", F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0)))
    return u.filter("pnvw is not null").select("month", "brand", "period_type", "numerator", "denominator", "pnvw")


def executive_view(landing: DataFrame, premonth: DataFrame, month: str) -> DataFrame:
    """Brand contributions of a month with the change against the value planned before it."""
    b = landing.filter(F.col("month") == month).groupBy("brand").agg(F.sum("revenue").alias("value"))
    p = premonth.filter(F.col("month") == month).groupBy("brand").agg(F.sum("revenue").alias("premonth"))
    tot = b.agg(F.sum("value").alias("total"))
    ch = F.col("value") - F.col("premonth")
    return b.join(p, "brand", "left").crossJoin(F.broadcast(tot)).select(
        "brand", "value", "premonth", ch.alias("change"), F.when(F.col("premonth") > 0, ch / F.col("premonth")).alias("change_pct"),
        F.when(F.col("total") > 0, F.col("value") / F.col("total")).alias("share"))


def brand_drivers(executive: DataFrame, wholesale: DataFrame, month: str) -> DataFrame:
    w = wholesale.filter(F.col("month") == month).groupBy("brand").agg(F.sum("wholesale_units").alias("wholesale"))
    tot = w.agg(F.sum("wholesale").alias("wt"))
    return executive.join(w, "brand", "left").crossJoin(F.broadcast(tot)).select(
        "brand", F.col("change").alias("original_forecast_change"), "wholesale", (F.col("wholesale") / F.nullif(F.col("wt"), F.lit(0.0))).alias("volume_share"),
        (F.col("value") / F.nullif(F.col("wholesale"), F.lit(0.0))).alias("pnvw"))


def component_split(records: DataFrame, value: Column, by: list[str]) -> DataFrame:
    fleet = F.col("component") == FLEET
    return records.groupBy(*by).agg(F.coalesce(F.sum(F.when(~fleet, value)), F.lit(0.0)).alias("regular"),
                                    F.coalesce(F.sum(F.when(fleet, value)), F.lit(0.0)).alias("fleet"))
