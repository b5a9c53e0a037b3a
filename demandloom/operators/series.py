"""Dense monthly series, packed or long, and window features over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import forecast as FC
from ..session import materialize


def pack(df: DataFrame, keys: list[str], value: Column, *, start: str | Column | None = None,
         end: str | Column | None = None) -> DataFrame:
    """keys -> (start_ord, n, h): gap-free, non-negative, one value per month.

    Values are summed to key x month first, so a group collects one number per month.
    ``start`` / ``end`` fix the range (month text) for all series.
    """
    as_ord = lambda m: D.month_ord(F.lit(m) if isinstance(m, str) else m)
    monthly = (df.filter(F.col("month").isNotNull()).groupBy(*keys, D.month_ord(F.col("month")).alias("o"))
               .agg(F.sum(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))).alias("v")))
    if end is not None and isinstance(end, str):
        monthly = monthly.filter(F.col("o") <= as_ord(end))
    # The work that follows a packed series is heavy per byte, so the number of tasks is fixed by
    # the session instead of being merged down by size; the grouping below reuses this layout.
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    monthly = monthly.repartition(n_tasks, *keys)
    g = monthly.groupBy(*keys).agg(F.min("o").alias("lo"), F.max("o").alias("hi"),
                                   F.map_from_entries(F.collect_list(F.struct("o", "v"))).alias("m"))
    lo = as_ord(start) if start is not None else F.col("lo")
    hi = as_ord(end) if end is not None else F.col("hi")
    h = F.transform(F.sequence(lo, hi), lambda o: F.coalesce(F.try_element_at("m", o), F.lit(0.0)))
    return g.select(*keys, lo.cast("int").alias("start_ord"), h.alias("h")).withColumn("n", F.size("h"))


#: Rows of the long form in one task; a window sorts them there.
LONG_ROWS = 1_000_000


def dealt(packed: DataFrame, keys: list[str], most: int = LONG_ROWS) -> DataFrame:
    """``packed`` in storage, dealt to as many tasks as its long form needs at about ``most`` rows each.

    The packed rows are dealt, which are few; windows by ``keys`` over the long form then need no further shuffle.
    """
    held = materialize(packed)
    rows = held.agg(F.sum(F.size("h"))).first()[0] or 0
    return held.repartition(max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), *keys)


def unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    return (packed.select(*keys, "start_ord", F.posexplode("h").alias("pos", "value"))
            .select(*keys, D.month_from_ord(F.col("start_ord") + F.col("pos")).alias("month"), "value"))


def anomalies_long(long: DataFrame, keys: list[str]) -> DataFrame:
    """Rolling-median / rolling-MAD anomaly scores on the dense long form."""
    w = Window.partitionBy(*keys).orderBy("month")
    f6 = w.rowsBetween(-5, 0)
    med = F.when(F.count("value").over(f6) >= 3, F.percentile("value", F.lit(0.5)).over(f6))
    d = long.withColumn("baseline", med).withColumn("resid", F.abs(F.col("value") - F.col("baseline")))
    mad = F.when(F.count("resid").over(f6) >= 3, F.percentile("resid", F.lit(0.5)).over(f6))
    d = d.withColumn("score", F.coalesce(F.col("resid") / F.nullif(mad, F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return d.filter((F.col("score") >= 2.0) & (F.col("len") >= 5)).select(
        *keys, "month", F.col("value").alias("actual"), "baseline",
        FC.pct(F.col("value") - F.col("baseline"), F.col("baseline")).alias("delta_pct"), "score",
        F.when(F.col("score") >= 3.5, "High").otherwise("Medium").alias("severity"))


def exposure_features(sales: DataFrame, wl: DataFrame) -> DataFrame:
    """Per part and month: quantity, quantity-weighted vehicle exposure, and their lags.

    Vehicles are pre-summed to month x model, so no row fans out; weights come from a
    group-and-join, so a month with very many rows is not gathered in one task.
    """
    g = (sales.groupBy("part_number", "month", "model_key").agg(F.sum("quantity").alias("q")))
    w = wl.groupBy("month", "model_key").agg(F.sum("wholesale_units").alias("wholesale"))
    j = g.join(w, ["month", "model_key"])
    m = j.groupBy("part_number", "month").agg(
        F.sum("q").alias("actual"), F.sum(F.col("wholesale") * F.col("q")).alias("wq")).withColumn(
        "exposure", F.when(F.col("actual") > 0, F.col("wq") / F.col("actual")).otherwise(0.0)).drop("wq")
    win = Window.partitionBy("part_number").orderBy("month")
    prior3 = win.rowsBetween(-3, -1)
    prev = F.lag("exposure").over(win)
    return (m.withColumn("months", F.count(F.lit(1)).over(Window.partitionBy("part_number"))).filter("months >= 7")
            .withColumns({
                "lag1": F.lag("actual", 1).over(win), "lag2": F.lag("actual", 2).over(win),
                "rolling3": F.when(F.count("actual").over(prior3) >= 2, F.avg("actual").over(prior3)),
                "exposure_change": F.coalesce((F.col("exposure") - prev) / F.nullif(prev, F.lit(0.0)), F.lit(0.0)),
                "time_idx": (F.row_number().over(win) - 1).cast("double")}))


def month_weights(df: DataFrame) -> DataFrame:
    """Share of each row in its month, by group and join (no window over a whole month)."""
    tot = df.groupBy("month").agg(F.sum("quantity").alias("month_total"))
    return df.join(F.broadcast(tot), "month").withColumn(       # one row per month
        "weight", F.when(F.col("month_total") > 0, F.col("quantity") / F.col("month_total")).otherwise(0.0))


def recent_signals(long: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("month")
    return long.withColumns({"recent6": F.sum("value").over(w.rowsBetween(-5, 0)),
                             "history": F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def change_windows(long: DataFrame, keys: list[str]) -> DataFrame:
    """Month-over-month change, recent-3 and prior-3 means, and the level against the recent 6."""
    w = Window.partitionBy(*keys).orderBy("month")
    prev = F.lag("value").over(w)
    r3, p3 = F.avg("value").over(w.rowsBetween(-2, 0)), F.avg("value").over(w.rowsBetween(-5, -3))
    r6 = F.avg("value").over(w.rowsBetween(-5, 0))
    return long.select("*", (F.col("value") - prev).alias("delta"), FC.pct(F.col("value") - prev, prev).alias("delta_pct"),
                       r3.alias("recent3"), p3.alias("prior3"), FC.pct(r3 - p3, p3).alias("shift_pct"),
                       FC.pct(F.col("value"), r6).alias("recent6_pct"))


def cumulative_by_year(monthly: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.substring("month", 1, 4)).orderBy("month")
    return monthly.withColumn("cumulative", F.sum("revenue").over(w))
