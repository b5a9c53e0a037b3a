"""Top-down allocation, part planning, reconciliation, allocation accuracy and exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import forecast as FC
from ..functions import text as T
from ..session import materialize
from . import forecasting as FO

EXCLUDED = ("excluded_lifecycle", "excluded_low_volume")
STOPPED = ("discontinued", "inactive")


def _ord(month: str) -> int:
    return int(month[:4]) * 12 + int(month[5:7]) - 1


def route(code: Column, active: Column, history: Column, average: Column, min_volume: float) -> Column:
    """Allocation route of a child series from its lifecycle and history."""
    young = code.isin("new", "reintroduced") | (history < 18)
    return (F.when(code.isin(*STOPPED), EXCLUDED[0])
            .when(young, F.when(average >= min_volume, "new_model_proxy").otherwise(EXCLUDED[1]))
            .when((active < 6) | (average < min_volume), EXCLUDED[1]).otherwise("regular_allocation"))


def _clipped() -> tuple[Column, Column]:
    return T.clip_zero(F.col("quantity")), F.greatest(F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)), F.lit(0.0))


def level_months(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts summed to (keys, month, lifecycle_code), with the number of facts that each row stands for in ``fact_rows``.

    What reads facts by these keys or fewer can read this instead, which is smaller by the facts that share them.
    """
    q, r = _clipped()
    return facts.groupBy(*keys, "month", "lifecycle_code").agg(F.sum(q).alias("quantity"), F.sum(r).alias("revenue"), F.count(F.lit(1)).alias("fact_rows"))


def month_totals(f: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, o, q, r, code): sums of a month and the code that most of its facts have, of facts or of ``level_months``."""
    q, r = _clipped()
    o = D.month_ord(F.col("month")).alias("o")
    if "fact_rows" not in f.columns:
        return f.groupBy(*keys, o).agg(F.sum(q).alias("q"), F.sum(r).alias("r"), T.mode_text("lifecycle_code").alias("code"))
    each = f.groupBy(*keys, o, T.usable_text(F.col("lifecycle_code")).alias("code")).agg(F.sum(q).alias("q"), F.sum(r).alias("r"), F.sum("fact_rows").alias("n"))
    most = F.min_by("code", F.when(F.col("code").isNotNull(), F.struct(-F.col("n"), F.col("code"))))
    return each.groupBy(*keys, "o").agg(F.sum("q").alias("q"), F.sum("r").alias("r"), F.coalesce(most, F.lit("")).alias("code"))


def child_profiles(facts: DataFrame, child: list[str], parent: list[str], cutoff: str, min_volume: float = 5.0) -> DataFrame:
    """One row per child: months as an array of (o, q, r), totals, route and expected unit price."""
    f = facts.filter(F.col("month") <= cutoff)
    q, r = _clipped()
    monthly = month_totals(f, child)
    c = monthly.groupBy(*child).agg(
        F.array_sort(F.collect_list(F.struct("o", "q", "r"))).alias("a"), F.mode("code", True).alias("lifecycle_code"),
        F.sum("q").alias("history_quantity"), F.sum("r").alias("history_revenue"),
        F.count_if(F.col("q") > 0).alias("active_months"), F.min("o").alias("first"), F.max("o").alias("last"))
    hist = F.greatest(F.lit(1), F.lit(_ord(cutoff)) - F.col("first") + 1)
    c = c.withColumn("history_months", hist).withColumn("monthly_average", F.col("history_quantity") / F.col("history_months"))
    c = c.withColumn("route", route(F.lower("lifecycle_code"), F.col("active_months"), F.col("history_months"), F.col("monthly_average"), min_volume))
    prices = (f.filter(D.month_ord(F.col("month")) >= _ord(cutoff) - 5).groupBy(*parent).agg(F.sum(q).alias("pq"), F.sum(r).alias("pr"))
              .select(*parent, F.when(F.col("pq") > 0, F.col("pr") / F.col("pq")).otherwise(0.0).alias("parent_price")))
    last3 = F.slice("a", F.greatest(F.size("a") - 2, F.lit(1)), 3)
    q3, r3 = FC.asum(F.transform(last3, lambda x: x["q"])), FC.asum(F.transform(last3, lambda x: x["r"]))
    price = F.coalesce(F.when((q3 > 0) & (r3 > 0), r3 / q3),
                       F.when((F.col("history_quantity") > 0) & (F.col("history_revenue") > 0), F.col("history_revenue") / F.col("history_quantity")),
                       F.greatest("parent_price", F.lit(0.0)), F.lit(0.0))
    return c.join(prices, parent, "left").withColumn("unit_price", price)


def signal(target: Column, metric: str, use_working_days: bool = True) -> Column:
    """Share signal of a child for a forecast month (needs columns of ``child_profiles`` and ``calendar_row``)."""
    regular = F.col("route") == "regular_allocation"
    look = F.when(regular, 6).otherwise(3)
    future = F.coalesce(F.try_element_at("days", target), F.col("mean_days"), F.lit(21.0))
    recent = FC.asum(F.transform(F.filter("a", lambda x: x["o"] > F.col("last") - look), lambda x: x["q"])) / look

    def day_mean(ords):
        d = F.filter(F.transform(ords, lambda o: F.try_element_at("days", o)), lambda v: F.coalesce(v, F.lit(0.0)) != 0)
        return F.coalesce(FC.amean(d), future)
    adj = (lambda base, ords: FC.let(day_mean(ords), lambda m: F.when(m > 0, base * (future / m)).otherwise(base))) if use_working_days else (lambda base, ords: base)
    rec = adj(recent, F.sequence(F.col("last") - look + 1, F.col("last")))
    same = F.filter("a", lambda x: x["o"] % 12 == target % 12)
    sea = adj(FC.amean(F.transform(same, lambda x: x["q"])), F.transform(same, lambda x: x["o"]))
    raw = F.when(regular & (F.size(same) >= 2), sea * 0.60 + rec * 0.40).otherwise(rec)
    raw = raw * F.greatest("unit_price", F.lit(0.0)) if metric == "revenue" else raw
    return F.when(F.col("route").isin(*EXCLUDED), 0.0).otherwise(F.greatest(raw, F.lit(0.0)))


def allocate(facts: DataFrame, parents: DataFrame, cal: DataFrame, *, child: list[str], parent: list[str], cutoff: str,
             metric: str = "quantity", min_volume: float = 5.0, use_working_days: bool = True) -> DataFrame:
    """Split parent forecasts (parent keys, month, value, forecast_type) over children so that they add up.

    Totals come from a group-and-join, so a parent with very many children is never one task.
    """
    p = parents.select(*parent, "month", F.col("value").alias("parent_value"), "forecast_type")
    c = child_profiles(facts, child, parent, cutoff, min_volume).crossJoin(F.broadcast(FO.calendar_row(cal)))   # one row
    c = c.join(p, parent).withColumn("o_target", D.month_ord(F.col("month")))
    c = FC.once(c, "raw", signal(F.col("o_target"), metric, use_working_days)).drop("a", "days", "moy")
    c = materialize(c)           # read twice: for the totals and for the shares
    ok = ~F.col("route").isin(*EXCLUDED)
    hist = F.when(ok, F.greatest(F.col("history_revenue" if metric == "revenue" else "history_quantity"), F.lit(0.0))).otherwise(0.0)
    c = c.withColumn("hist", hist)
    tot = c.groupBy(*parent, "month").agg(F.sum("raw").alias("raw_total"), F.sum("hist").alias("hist_total"), F.count_if(ok).alias("eligible"))
    c = c.join(tot, parent + ["month"])
    use = (F.when(F.col("raw_total") > 0, F.col("raw")).when(F.col("eligible") == 0, 0.0)
           .when(F.col("hist_total") > 0, F.col("hist")).otherwise(F.when(ok, 1.0).otherwise(0.0)))
    base = (F.when(F.col("raw_total") > 0, F.col("raw_total")).when(F.col("eligible") == 0, 0.0)
            .when(F.col("hist_total") > 0, F.col("hist_total")).otherwise(F.col("eligible").cast("double")))
    c = c.withColumn("share", F.coalesce(use / F.nullif(base, F.lit(0.0)), F.lit(0.0)))
    c = c.withColumn("factor", F.coalesce(F.col("parent_value") / F.nullif(base, F.lit(0.0)), F.lit(0.0)))
    rows = c.select(*child, "month", "forecast_type", "route", F.greatest(F.lit(0.0), use * F.col("factor")).alias("value"), "share", "factor",
                    "parent_value", "active_months", "history_months", "monthly_average", "history_quantity", "history_revenue", "unit_price")
    rest = p.join(tot.filter("eligible > 0").select(*parent, "month"), parent + ["month"], "left_anti")
    fill = {k: F.col(k) if k in parent else F.lit("Planner review residual") for k in child}
    if "entity_key" in child and "entity_key" not in parent:
        fill["entity_key"] = F.concat(F.col("brand"), F.lit("::PLANNER_REVIEW_RESIDUAL"))
    zero = F.lit(0.0)
    residual = rest.select(*[v.alias(k) for k, v in fill.items()], "month", "forecast_type", F.lit("planner_review_residual").alias("route"),
                           F.greatest(zero, F.col("parent_value")).alias("value"), F.lit(1.0).alias("share"), F.col("parent_value").alias("factor"),
                           "parent_value", F.lit(0).cast("bigint").alias("active_months"), F.lit(0).alias("history_months"), zero.alias("monthly_average"),
                           zero.alias("history_quantity"), zero.alias("history_revenue"), zero.alias("unit_price"))
    return rows.unionByName(residual)


def routing_summary(levels: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    out = [df.select(*keys[name], "route").distinct().groupBy("route").agg(F.count(F.lit(1)).alias("series")).withColumn("level", F.lit(name))
           for name, df in levels.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


def reconciliation(parents: DataFrame, children: DataFrame, parent: list[str], tolerance: float = 0.01) -> DataFrame:
    """Largest gap between a parent and the sum of its children; PASS within the tolerance."""
    kids = children.groupBy(*parent, "month").agg(F.sum("value").alias("child_value"))
    d = parents.join(kids, parent + ["month"], "left").agg(
        F.coalesce(F.max(F.abs(F.col("value") - F.coalesce("child_value", F.lit(0.0)))), F.lit(0.0)).alias("max_delta"), F.count(F.lit(1)).alias("checked"))
    return d.withColumn("status", F.when(F.col("max_delta") <= tolerance, "PASS").otherwise("FAIL"))


def top_plcs(facts: DataFrame, plc_forecast: DataFrame, cutoff: str, top_n: int = 10) -> DataFrame:
    """PLCs by historical revenue with rank, share and forecast summed over brands and models."""
    h = facts.filter(F.col("month") <= cutoff).groupBy("plc").agg(F.sum("revenue").cast("double").alias("history_revenue"))
    tot = h.agg(F.sum(F.greatest("history_revenue", F.lit(0.0))).alias("total"))
    f = plc_forecast.filter("plc <> ''").groupBy("plc", "month").agg(F.sum("value").alias("value"))
    known = f.select("plc").distinct().join(h, "plc", "left").withColumn("history_revenue", F.coalesce("history_revenue", F.lit(0.0)))
    top = known.orderBy(F.desc("history_revenue"), "plc").limit(top_n)                   # a report of top_n rows
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("history_revenue"), "plc"))).crossJoin(F.broadcast(tot))
    return f.join(F.broadcast(top), "plc").select(
        "plc", "rank", "history_revenue", F.when(F.col("total") > 0, F.col("history_revenue") / F.col("total") * 100).otherwise(0.0).alias("share_pct"), "month", "value")


def part_stats(facts: DataFrame, cutoff: str, parent=("brand", "entity_key", "plc")) -> DataFrame:
    """One row per part of a parent that sold lately: recent and latest volumes, active months, average. The same for every metric."""
    parent = list(parent)
    part = parent + ["part_number", "part_description"]
    f, end = facts.filter(F.col("month") <= cutoff), _ord(cutoff)
    o = D.month_ord(F.col("month")).alias("o")             # numbers are merged in place where texts would be sorted
    last = f.groupBy(*parent).agg(F.max(o).alias("basis"))
    m = f.groupBy(*part, o).agg(F.sum("quantity").alias("q"), F.sum(F.col("revenue").cast("double")).alias("r")).join(last, parent)
    rec, lat = F.col("o") >= end - 5, F.col("o") == F.col("basis")
    s0 = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    st = m.groupBy(*part, "basis").agg(
        s0(F.when(rec, F.col("q"))).alias("rq"), s0(F.when(rec, F.col("r"))).alias("rr"), s0(F.when(lat, F.col("q"))).alias("lq"),
        F.count_if(F.col("q") > 0).alias("active"), F.min("o").alias("first"), F.sum("q").alias("hq"), F.count_if(rec | lat).alias("seen")).filter("seen > 0")
    months = F.greatest(F.lit(1), F.lit(end) - F.col("first") + 1)
    return st.withColumns({"basis_month": D.month_from_ord(F.col("basis")), "average": F.col("hq") / months,
                           "unit_revenue": F.when(F.col("rq") > 0, F.col("rr") / F.col("rq")).otherwise(0.0)})


def part_plan(facts: DataFrame, parents: DataFrame, cutoff: str, metric: str = "quantity", parent=("brand", "entity_key", "plc"),
              min_volume: float = 5.0, stats: DataFrame | None = None) -> DataFrame:
    """Exact-part rows: eligible parts share the parent forecast by latest, else recent, volume.

    Parents without an eligible part keep their value on one review row. ``stats``: stored ``part_stats``, where several plans share them.
    """
    parent = list(parent)
    part = parent + ["part_number", "part_description"]
    st = materialize(part_stats(facts, cutoff, parent)) if stats is None else stats           # read several times
    routes = parents.groupBy(*parent).agg(F.min("route").alias("route"))
    st = st.join(routes, parent)
    ok = F.when(F.col("route") == "new_model_proxy", (F.col("rq") > 0) & (F.col("average") >= min_volume)).otherwise(
        (F.col("active") >= 6) & (F.col("average") >= min_volume))
    unit = F.col("unit_revenue") if metric == "revenue" else F.lit(1.0)
    st = st.withColumns({"ok": ok, "w_latest": F.col("lq") * unit, "w_recent": F.col("rq") * unit})
    tot = st.groupBy(*parent).agg(F.sum("w_latest").alias("all_latest"), F.sum(F.when(F.col("ok"), F.col("w_latest")).otherwise(0.0)).alias("ok_latest"),
                                  F.sum(F.when(F.col("ok"), F.col("w_recent")).otherwise(0.0)).alias("ok_recent"))
    st = st.join(tot, parent)
    on_latest = F.col("all_latest") > 0
    base = F.when(on_latest, F.col("ok_latest")).otherwise(F.col("ok_recent"))
    st = st.filter("ok").withColumn("part_share", F.when(on_latest, F.col("w_latest")).otherwise(F.col("w_recent")) / F.nullif(base, F.lit(0.0))).filter("part_share is not null")
    lo = F.col("lower") if "lower" in parents.columns else F.col("value")
    hi = F.col("upper") if "upper" in parents.columns else F.col("value")
    pf = parents.select(*parent, "month", "forecast_type", F.col("value").alias("pv"), lo.alias("plo"), hi.alias("phi"))
    cols = lambda: [F.greatest(F.lit(0.0), F.col("plo") * F.col("part_share")).alias("lower"),
                    F.greatest(F.col("pv") * F.col("part_share"), F.col("phi") * F.col("part_share")).alias("upper")]
    rows = st.join(pf, parent).select(*part, "month", "forecast_type", "basis_month", "part_share", "route", "unit_revenue",
                                      (F.col("pv") * F.col("part_share")).alias("value"), *cols())
    positive = pf.groupBy(*parent).agg(F.max("pv").alias("mx")).filter("mx > 0").select(*parent)
    rest = pf.join(positive, parent, "left_semi").join(st.select(*parent).distinct(), parent, "left_anti").withColumn("part_share", F.lit(1.0))
    review = rest.select(*parent, F.lit("PLANNER_REVIEW").alias("part_number"), F.lit("Unallocated low-volume / lifecycle residual").alias("part_description"),
                         "month", "forecast_type", F.lit(None).cast("string").alias("basis_month"), "part_share",
                         F.lit("planner_review_residual").alias("route"), F.lit(0.0).alias("unit_revenue"), F.col("pv").alias("value"), *cols())
    return rows.unionByName(review)


def part_bundle(quantity: DataFrame, revenue: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity plan with the revenue plan and the reference revenue (quantity x unit revenue)."""
    r = revenue.select(*keys, F.col("value").alias("revenue_plan"), F.col("unit_revenue").alias("unit"))
    return quantity.join(r, keys, "left").select(
        *keys, F.col("value").alias("quantity_plan"), "revenue_plan", (F.col("value") * F.coalesce("unit", "unit_revenue")).alias("reference_revenue"))


def inherit_bounds(children: DataFrame, parents: DataFrame, parent: list[str]) -> DataFrame:
    """Child bounds in proportion to the parent's; the value itself without a parent row."""
    p = parents.select(*parent, "month", F.col("value").alias("pv"), F.col("lower").alias("plo"), F.col("upper").alias("phi"))
    j = children.join(p, parent + ["month"], "left")
    v, ratio = F.col("value"), F.when(F.col("pv") > 0, F.col("value") / F.col("pv")).otherwise(0.0)
    low = F.when(F.col("pv").isNull(), v).otherwise(F.least(v, F.greatest(F.lit(0.0), F.col("plo") * ratio)))
    high = F.when(F.col("pv").isNull(), v).otherwise(F.greatest(v, F.col("phi") * ratio))
    return j.withColumn("lower", low).withColumn("upper", high).drop("pv", "plo", "phi")


def allocation_folds(facts: DataFrame, child: list[str], parent: list[str], cutoff: str, value: str = "quantity", least: int = 24,
                     horizons: int = 3) -> DataFrame:
    """Held-out child actuals against parent actual x origin-known share.

    Long form: a child has a row a month, with its sums of the last six months and of all months so far as window frames and the
    next months' values beside them. A parent's are the sums over its children, framed alike, so that each child row meets one
    parent row, joined on parent and month; nothing of a parent's history is copied into its children.
    """
    f, end, ahead = facts.filter(F.col("month") <= cutoff), _ord(cutoff), range(1, horizons + 1)
    v = F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    monthly = f.groupBy(*child, D.month_ord(F.col("month")).alias("o")).agg(F.sum(v).alias("v"))
    start = facts.agg(F.min(D.month_ord(F.col("month"))).alias("s0"))       # one row

    def framed(rows, keys, early):
        """Months of each key, from ``early`` months before its first to the cutoff."""
        own = rows.groupBy(*keys).agg(F.min("o").alias("first"), F.map_from_entries(F.collect_list(F.struct("o", "v"))).alias("m"))
        grid = own.select(*keys, "first", "m", F.explode(F.sequence(F.col("first") - early, F.lit(end))).alias("o"))
        grid = grid.select(*keys, "first", "o", F.try_element_at("m", F.col("o")).alias("sold"))
        w = Window.partitionBy(*keys).orderBy("o")
        x = F.coalesce("sold", F.lit(0.0))
        return grid.select(*keys, "first", "o", F.sum(x).over(w.rowsBetween(-5, 0)).alias("recent"), F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("whole"),
                           F.array(*[F.lead("sold", k).over(w) for k in ahead]).alias("next"))
    kids = framed(monthly, child, horizons).crossJoin(F.broadcast(start)).filter((F.col("o") >= F.col("s0") + least - 1) & (F.col("o") < end))
    par = framed(monthly.groupBy(*parent, "o").agg(F.sum("v").alias("v")), parent, 0).select(
        *parent, "o", F.col("recent").alias("pr"), F.col("whole").alias("ph"), F.col("next").alias("pnext"))
    j = kids.join(par, [*parent, "o"], "left")
    share = F.when(F.col("pr") > 0, F.col("recent") / F.col("pr")).when(F.col("ph") > 0, F.col("whole") / F.col("ph")).otherwise(0.0)
    known = F.col("first") <= F.col("o")
    j = j.select(*child, "o", "next", "pnext", known.alias("known"), F.when(known, share).otherwise(0.0).alias("share"),
                 (known & F.coalesce((F.col("pr") > 0) | (F.col("ph") > 0), F.lit(False))).alias("covered"))
    e = j.select(*child, "o", "known", "share", "covered", "pnext", F.posexplode("next").alias("i", "sold")).filter(
        (F.col("o") + F.col("i") + 1 <= end) & (F.col("known") | F.col("sold").isNotNull()))
    prediction = F.coalesce(F.get("pnext", F.col("i")), F.lit(0.0)) * F.col("share")
    return e.select(*child, D.month_from_ord(F.col("o")).alias("origin_month"), D.month_from_ord(F.col("o") + F.col("i") + 1).alias("target_month"),
                    (F.col("i") + 1).alias("horizon"), F.coalesce("sold", F.lit(0.0)).alias("actual"), F.greatest(prediction, F.lit(0.0)).alias("prediction"), "covered")


LEVELS = (("Model", ("brand", "entity_key", "model_name")), ("PLC", ("brand", "entity_key", "model_name", "plc")),
          ("PIS_PNO", ("brand", "entity_key", "model_name", "plc", "part_number")))


def exception_profiles(facts: DataFrame, cutoff: str, levels: DataFrame | None = None) -> DataFrame:
    """History profile at model, PLC and part level, from one grouping-sets pass; with ``levels`` (``level_months`` by PLC) the two
    upper levels come from there and the facts are only grouped by part."""
    dims = list(LEVELS[2][1])
    if levels is None:
        q, r = _clipped()
        f = facts.filter(F.col("month") <= cutoff).withColumns({"q": q, "r": r, "o": D.month_ord(F.col("month"))})
        m = f.groupingSets([tuple(d) + ("o",) for _, d in LEVELS], *dims, "o").agg(
            F.sum("q").alias("q"), F.sum("r").alias("r"), T.mode_text("lifecycle_code").alias("code"), F.grouping_id().alias("gid"))
        m = m.withColumn("scope", F.when(F.col("gid") == 6, "Model").when(F.col("gid") == 2, "PLC").otherwise("PIS_PNO"))
    else:
        none = F.lit(None).cast("string")
        each = [month_totals(df.filter(F.col("month") <= cutoff), list(d)).withColumns({k: none for k in dims if k not in d} | {"scope": F.lit(name)})
                for (name, d), df in zip(LEVELS, (levels, levels, facts), strict=True)]
        m = reduce(lambda a, b: a.unionByName(b), each)
    o = F.col("o")
    c = _ord(cutoff)
    s = m.groupBy("scope", *dims).agg(
        F.sum("q").alias("history_quantity"), F.sum("r").alias("history_revenue"), F.count_if(F.col("q") > 0).alias("active_months"),
        F.count(F.lit(1)).alias("observed_months"), F.count_if((o >= c - 2) & (F.col("q") > 0)).alias("recent_positive"),
        F.sum(F.when(o >= c - 5, F.col("q")).otherwise(0.0)).alias("recent6_quantity"), F.sum(F.when(o >= c - 5, F.col("r")).otherwise(0.0)).alias("recent6_revenue"),
        F.sum(F.when(o == c, F.col("q")).otherwise(0.0)).alias("latest_quantity"), F.sum(F.when(o == c, F.col("r")).otherwise(0.0)).alias("latest_revenue"),
        F.min("o").alias("first"), F.mode("code", True).alias("lifecycle_code"))
    s = s.withColumn("first_month", D.month_from_ord(F.col("first"))).withColumn("history_months", F.lit(c) - F.col("first") + 1).drop("first")
    return s.withColumns({
        "series_key": F.concat_ws("::", *dims), "missing_months": F.greatest(F.col("history_months") - F.col("observed_months"), F.lit(0)),
        "monthly_average": F.col("history_quantity") / F.greatest("history_months", F.lit(1)),
        "unit_revenue": F.when(F.col("history_quantity") > 0, F.col("history_revenue") / F.col("history_quantity")).otherwise(0.0)})


def exceptions(profiles: DataFrame, models: DataFrame, plcs: DataFrame, parts: DataFrame | None = None, metric: str = "quantity", min_volume: float = 5.0) -> DataFrame:
    """Exception rows from series profiles and from the forecasts of three levels, deduplicated by id.

    ``models`` and ``plcs`` are allocated forecasts; ``parts`` is a part plan by PLC of one model, read for revenue only.
    Rules on histories: stopped, low volume, few active months, gaps, recent zeros, new. Rules on forecast months: a
    zero (or, for a series that was excluded and has no row, no) revenue forecast although revenue was earned before;
    a value left to planners at model or PLC level; a positive PLC value without any part that could take it.
    """
    low, code = F.lit(min_volume), F.lower("lifecycle_code")

    def ev(**kw):
        return F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))

    def rule(cond, reason, severity, evidence, action):
        return F.when(cond, F.struct(F.lit(reason).alias("reason"), F.lit(severity).alias("severity"), evidence.alias("evidence"), F.lit(action).alias("action")))

    def monthly(df, scope, key, reason, severity, evidence, action):
        return df.select(scope.alias("scope"), key.alias("series_key"), F.lit(reason).alias("reason"), F.lit(severity).alias("severity"), evidence.alias("evidence"),
                         F.lit(action).alias("action"), F.col("month").alias("forecast_month"))
    rules = F.array(
        rule(code.isin(*STOPPED), "inactive_discontinued", "high", ev(lifecycle=code), "confirm_lifecycle_keep_zero"),
        rule(F.col("monthly_average") < low, "low_volume", "medium", ev(monthly_average=F.round("monthly_average", 4), minimum=low), "review_sparse_demand"),
        rule(F.col("active_months") < 6, "insufficient_active_months", "medium", ev(active_months=F.col("active_months")), "collect_history_or_proxy"),
        rule(F.col("missing_months") > 0, "history_gaps", "medium", ev(missing_months=F.col("missing_months")), "confirm_zero_or_missing"),
        rule((F.col("recent_positive") == 0) & (F.col("history_months") >= 3), "recent_zero_streak", "high", ev(streak=F.lit(3)), "review_lifecycle_and_supply"),
        rule(code.isin("new", "reintroduced"), "new_reintroduced_proxy", "medium", ev(history_months=F.col("history_months")), "review_proxy"))
    out = profiles.select("scope", "series_key", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("x")).select(
        "scope", "series_key", "x.*", F.lit(None).cast("string").alias("forecast_month"))
    dims = {name: list(d) for name, d in LEVELS}
    level = lambda df, name: df.select(F.lit(name).alias("scope"), F.concat_ws("::", *dims[name]).alias("series_key"), "month", "route", "value")
    both = level(models, "Model").unionByName(level(plcs, "PLC"))
    out = out.unionByName(monthly(both.filter("route = 'planner_review_residual'"), F.col("scope"), F.col("series_key"), "planner_review_residual", "high",
                                  ev(value=F.round("value", 4)), "assign_residual_to_children"))
    stopped = F.coalesce(code.isin(*STOPPED), F.lit(False))
    routes = plcs.groupBy(*dims["PLC"]).agg(F.min("route").alias("route"))
    able = (F.col("monthly_average") >= low) & ~stopped & F.when(F.col("route") == "new_model_proxy", F.col("recent6_quantity") > 0).otherwise(F.col("active_months") >= 6)
    price = F.when(F.col("recent6_quantity") > 0, F.col("recent6_revenue") / F.col("recent6_quantity")).otherwise(F.col("unit_revenue")) if metric == "revenue" else F.lit(1.0)
    served = (profiles.filter("scope = 'PIS_PNO'").join(routes, dims["PLC"]).filter(able).groupBy(*dims["PLC"])
              .agg(F.sum(F.col("latest_quantity") * price).alias("latest"), F.sum(F.col("recent6_quantity") * price).alias("recent")).filter("latest > 0 or recent > 0"))
    unserved = plcs.filter("value > 0").join(served.select(*dims["PLC"]), dims["PLC"], "left_anti")
    out = out.unionByName(monthly(unserved, F.lit("PIS_PNO"), F.concat_ws("::", *dims["PLC"], F.lit("PLANNER_REVIEW")), "planner_review_residual", "high",
                                  ev(value=F.round("value", 4)), "assign_residual_to_parts"))
    if metric == "revenue":
        given = both if parts is None else both.unionByName(level(parts, "PIS_PNO"))
        priced = profiles.filter("unit_revenue > 0")
        zero = given.filter("value = 0").join(priced.select("scope", "series_key", "unit_revenue"), ["scope", "series_key"])
        months = models.select("month").distinct()                                                   # the forecast horizon
        excluded = (F.col("monthly_average") < low) | (F.col("active_months") < 6) | stopped | ((F.col("scope") == "PIS_PNO") & (F.col("recent6_quantity") <= 0))
        lost = (priced.filter(excluded).join(given.select("scope", "series_key").distinct(), ["scope", "series_key"], "left_anti")
                .select("scope", "series_key", "unit_revenue").crossJoin(F.broadcast(months)))
        out = out.unionByName(monthly(zero.select("scope", "series_key", "unit_revenue", "month").unionByName(lost), F.col("scope"), F.col("series_key"),
                                      "zero_forecast_historical_unit_price", "medium", ev(unit_revenue=F.round("unit_revenue", 4)), "review_routing"))
    return out.withColumn("exception_id", F.concat_ws("::", "reason", "series_key", F.coalesce("forecast_month", F.lit("SERIES")))).dropDuplicates(["exception_id"])
