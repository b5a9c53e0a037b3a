"""Wholesale reshaping, anchor resolution and the monthly fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXACT_ANCHOR_METHODS, AnchorPolicy, BasketPolicy
from ..functions import dates as D
from ..functions import text as T

FACT_KEYS = ["month", "brand", "anchor_brand", "anchor_method", "entity_key", "model_key",
             "model_name", "model_year", "plc", "part_number"]


def wholesale_long(rows: DataFrame, policy: AnchorPolicy = AnchorPolicy(), source: str = "wholesale") -> DataFrame:
    """Regroup wholesale rows to month x anchor x model; rows without a governed anchor drop out."""
    sheet = F.col("source_sheet") if "source_sheet" in rows.columns else F.lit(source)
    fleet = F.col("channel") == "fleet"
    units = T.clip_zero(F.col("units"))
    base = rows.select(
        "month", T.blank("brand").alias("brand"), T.blank("model_name").alias("model_name"),
        T.blank("model_code").alias("model_code"), sheet.alias("source_sheet"), fleet.alias("fleet"),
        units.alias("units")).filter(
            (F.col("model_name") != "") & ~T.is_total(F.col("model_name")) & ~T.is_total(F.col("brand")))
    base = base.withColumn("anchor_brand", T.anchor_label(F.col("brand"), F.col("model_name"), F.lit("")))
    return (base.filter(F.col("anchor_brand").isin(*policy.anchors))
            .groupBy("month", "anchor_brand", T.normalize_name("model_name").alias("model_key"))
            .agg(T.join_unique("brand").alias("brand"), T.mode_text("model_name").alias("model_name"),
                 T.join_unique("model_code").alias("model_code"),
                 F.sum(F.when(~F.col("fleet"), F.col("units")).otherwise(0.0)).alias("wholesale_units"),
                 F.sum(F.when(F.col("fleet"), F.col("units")).otherwise(0.0)).alias("fleet_units"),
                 T.join_unique(F.when(F.col("fleet"), "Fleet").otherwise("Dealer / non-fleet")).alias("channel"),
                 T.join_unique("source_sheet").alias("source_sheet")))


def union_wholesale(frames: list[DataFrame]) -> DataFrame:
    """Stack per-sheet long frames and regroup them to one row per key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return (out.groupBy("month", "anchor_brand", "model_key")
            .agg(T.join_unique("brand").alias("brand"), T.mode_text("model_name").alias("model_name"),
                 T.join_unique("model_code").alias("model_code"),
                 F.sum("wholesale_units").alias("wholesale_units"), F.sum("fleet_units").alias("fleet_units"),
                 T.join_unique("channel").alias("channel"), T.join_unique("source_sheet").alias("source_sheet")))


def anchor_map(wl: DataFrame, policy: AnchorPolicy = AnchorPolicy()) -> DataFrame:
    """Anchor with most dealer volume per model, plus spelling aliases whose candidates all agree.

    Volumes are aggregated to model x anchor (at most models x anchors rows) before any ranking.
    """
    vol = (wl.filter((F.col("model_key") != "") & F.col("anchor_brand").isin(*policy.anchors))
           .groupBy("model_key", "anchor_brand")
           .agg(F.sum(T.clip_zero("wholesale_units")).alias("units"),
                F.count_if(F.col("wholesale_units") > 0).alias("active")))
    best_first = F.struct(-F.col("units"), -F.col("active"), F.col("anchor_brand"))
    per_model = vol.groupBy("model_key").agg(
        F.min_by("anchor_brand", best_first).alias("anchor_brand"),
        F.min_by("units", best_first).alias("units"),
        F.array_sort(F.collect_set(F.when(F.col("units") > 0, F.col("anchor_brand")))).alias("pos"),
        F.array_sort(F.collect_set("anchor_brand")).alias("all"))
    cands = F.when(F.size("pos") > 0, F.col("pos")).otherwise(F.col("all"))
    exact = per_model.select(
        "model_key", "anchor_brand",
        F.when(F.size(cands) == 1, EXACT_ANCHOR_METHODS[0]).otherwise(EXACT_ANCHOR_METHODS[1]).alias("method"),
        F.array_join(cands, " / ").alias("candidates"), "units")
    # every model offers its own name and its aliases; a name of its own wins over any alias
    own = F.col("key") == F.col("model_key")
    offers = exact.select("*", F.explode(F.array_union(F.array("model_key"), T.model_aliases("model_key"))).alias("key"))
    g = offers.groupBy("key").agg(
        F.max(F.when(own, F.struct("anchor_brand", "method", "candidates", "units"))).alias("self"),
        F.min(F.when(~own, F.col("anchor_brand"))).alias("lo"), F.max(F.when(~own, F.col("anchor_brand"))).alias("hi"),
        F.sum(F.when(~own, F.col("units"))).alias("alias_units"))
    pick = lambda field, other: F.when(F.col("self").isNotNull(), F.col(f"self.{field}")).otherwise(other)
    return g.filter("self is not null or lo = hi").select(
        F.col("key").alias("model_key"), pick("anchor_brand", F.col("lo")).alias("anchor_brand"),
        pick("method", F.lit(EXACT_ANCHOR_METHODS[2])).alias("method"), pick("candidates", F.col("lo")).alias("candidates"),
        pick("units", F.col("alias_units")).alias("units"))


def assign_anchor(df: DataFrame, amap: DataFrame, policy: AnchorPolicy = AnchorPolicy()) -> DataFrame:
    """Add anchor_brand and anchor_method by the map, then source letter, name prefix, default."""
    m = amap.select(F.col("model_key"), F.col("anchor_brand").alias("__a"), F.col("method").alias("__m"))
    src = T.normalize_name("brand")
    letter, prefix = src == policy.fallback_letter, T.starts_with_any(F.col("model_key"), policy.prefixes)
    return (df.join(m, "model_key", "left")
            .withColumn("anchor_brand", F.coalesce("__a", F.when(letter, policy.fallback_letter_anchor)
                        .when(prefix, policy.prefix_anchor).otherwise(policy.default_anchor)))
            .withColumn("anchor_method", F.coalesce("__m", F.when(letter, policy.letter_method)
                        .when(prefix, policy.prefix_method).otherwise(policy.default_method)))
            .drop("__a", "__m"))


def clean_sales(sales: DataFrame, start_year: int, end_year: int) -> DataFrame:
    desc, part = T.blank("part_description"), T.blank("part_number")
    plc = F.coalesce(F.nullif(T.blank("plc"), F.lit("")), F.nullif(desc, F.lit("")), part)
    zero = F.lit(0).cast("decimal(18,4)")
    return sales.select(
        "sale_date", D.month_of("sale_date").alias("month"), T.blank("brand").alias("brand"),
        T.blank("model_name").alias("model_name"), T.normalize_name("model_name").alias("model_key"),
        T.blank("model_code").alias("model_code"), T.model_year("model_year").alias("model_year"),
        part.alias("part_number"), desc.alias("part_description"), plc.alias("plc"),
        T.clip_zero(F.col("quantity")).alias("quantity"),
        F.greatest(F.coalesce(F.col("revenue"), zero), zero).alias("revenue"),
    ).filter((F.col("sale_date") >= F.lit(f"{start_year:04d}-01-01").cast("date")) & (F.col("sale_date") < F.lit(f"{end_year + 1:04d}-01-01").cast("date"))
             & (F.col("model_key") != "") & (F.col("part_number") != ""))


def monthly_facts(sales: DataFrame, wl: DataFrame | None = None, calendar: DataFrame | None = None,
                  lifecycle: DataFrame | None = None, *, start_year: int = 2023, end_year: int = 2026,
                  policy: AnchorPolicy = AnchorPolicy()) -> DataFrame:
    """The central table. One shuffle for the aggregate: the anchor depends only on
    (brand, model), so it is joined after grouping, on far fewer rows than the sales."""
    keys = ["month", "brand", "model_key", "model_name", "model_year", "plc", "part_number"]
    g = clean_sales(sales, start_year, end_year).groupBy(*keys).agg(
        T.join_unique("model_code").alias("model_code"), T.mode_text("part_description").alias("part_description"),
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"),
        F.count(F.lit(1)).alias("source_rows"))
    if wl is not None:
        g = assign_anchor(g, anchor_map(wl, policy), policy)
    else:
        src = T.normalize_name("brand")
        g = (g.withColumn("anchor_brand", F.when(src == policy.fallback_letter, policy.fallback_letter_anchor)
                          .when(T.starts_with_any(F.col("model_key"), policy.prefixes), policy.prefix_anchor)
                          .otherwise(policy.default_anchor))
             .withColumn("anchor_method", F.when(src == policy.fallback_letter, policy.letter_method)
                         .when(T.starts_with_any(F.col("model_key"), policy.prefixes), policy.prefix_method)
                         .otherwise(policy.default_method)))
    g = g.withColumn("entity_key", T.entity_key("model_name", "brand"))
    g = join_wholesale(g, wl) if wl is not None else g.withColumns(
        {"wholesale_units": F.lit(None).cast("double"), "fleet_units": F.lit(None).cast("double")})
    g = join_calendar(g, calendar) if calendar is not None else g.withColumn("working_days", F.lit(None).cast("double"))
    g = join_lifecycle(g, lifecycle)
    return add_ratios(g).select(
        "month", "brand", "anchor_brand", "anchor_method", "entity_key", "model_key", "model_name", "model_code",
        "model_year", "plc", "part_number", "part_description", "lifecycle_status", "lifecycle_code", "quantity",
        "revenue", "wholesale_units", "fleet_units", "units_per_vehicle", "revenue_per_vehicle", "pnvw",
        "working_days", "qty_per_working_day", "source_rows")


def join_wholesale(facts: DataFrame, wl: DataFrame, use_anchor: bool = True) -> DataFrame:
    """Left join of wholesale pre-summed to the join key, so a fact row never fans out."""
    keys = ["month", "anchor_brand", "model_key"] if use_anchor else ["month", "model_key"]
    agg = wl.groupBy(*keys).agg(F.sum("wholesale_units").alias("wholesale_units"),
                                F.sum("fleet_units").alias("fleet_units"))
    return facts.join(agg, keys, "left")


def join_calendar(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    # a calendar has one row per month: a few hundred rows whatever the data size
    return facts.join(F.broadcast(calendar.select("month", "working_days")), "month", "left")


def join_lifecycle(facts: DataFrame, lifecycle: DataFrame | None) -> DataFrame:
    if lifecycle is None:
        return facts.withColumns({"lifecycle_status": F.lit("Unknown"), "lifecycle_code": F.lit("unknown")})
    first = lifecycle.groupBy("entity_key").agg(F.min(F.struct("status", "status_code")).alias("s"))
    first = first.select("entity_key", F.col("s.status").alias("__s"), F.col("s.status_code").alias("__c"))
    return (facts.join(first, "entity_key", "left")
            .withColumn("lifecycle_status", F.coalesce("__s", F.lit("Unknown")))
            .withColumn("lifecycle_code", F.coalesce("__c", F.lit("unknown"))).drop("__s", "__c"))


def add_ratios(facts: DataFrame) -> DataFrame:
    wu, wd = F.nullif(F.col("wholesale_units"), F.lit(0.0)), F.nullif(F.col("working_days"), F.lit(0.0))
    per_vehicle = F.col("revenue").cast("double") / wu
    return facts.withColumns({
        "units_per_vehicle": F.col("quantity") / wu, "revenue_per_vehicle": per_vehicle, "pnvw": per_vehicle,
        "qty_per_working_day": F.col("quantity") / wd})


def working_days(df: DataFrame, month_col: str, days_col: str) -> DataFrame:
    """Calendar from a raw table: month text of mixed spelling, largest day count per month."""
    m = D.month_of(D.mixed_date(F.col(month_col)))
    days = F.greatest(F.col(days_col).cast("string").try_cast("double"), F.lit(0.0))
    return (df.select(m.alias("month"), days.alias("working_days")).dropna()
            .groupBy("month").agg(F.max("working_days").alias("working_days")))


def fact_summary(facts: DataFrame) -> DataFrame:
    """One row of totals and distinct counts. Facts are grouped by each dimension on its own, with sums that are merged in place; a
    distinct count is the number of its groups, and the months' sums add up to the totals."""
    exact = F.col("anchor_method").isin(*EXACT_ANCHOR_METHODS)
    dims = ["month", "brand", "anchor_brand", "entity_key", "plc", "part_number"]
    g = facts.groupingSets([(d,) for d in dims], *dims).agg(
        F.grouping_id(*dims).alias("gid"), F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q"), F.sum("revenue").alias("r"),
        F.sum(F.when(exact, F.col("quantity"))).alias("exact"), F.count("wholesale_units").alias("wu"), F.count("working_days").alias("wd"))
    whole = lambda c: F.sum(F.when(F.col("gid") == (1 << (len(dims) - 1)) - 1, F.col(c)))                    # over the months
    q, n = whole("q"), F.coalesce(whole("n"), F.lit(0))
    nn = lambda c: F.round(whole(c) * 100.0 / F.nullif(n, F.lit(0)), 2)
    return g.agg(
        n.alias("row_count"), F.count("month").alias("month_count"), F.min("month").alias("min_month"), F.max("month").alias("max_month"),
        F.count("brand").alias("brand_count"), F.count("anchor_brand").alias("anchor_count"),
        F.count("entity_key").alias("model_count"), F.count("plc").alias("plc_count"),
        F.count("part_number").alias("part_count"), q.alias("total_quantity"),
        whole("r").cast("double").alias("total_revenue"),
        F.round(F.coalesce(whole("exact") / F.nullif(q, F.lit(0.0)) * 100, F.lit(0.0)), 2)
        .alias("exact_quantity_pct"),
        nn("wu").alias("wholesale_coverage_pct"), nn("wd").alias("working_days_coverage_pct"))


def channel_baskets(facts: DataFrame, wl: DataFrame, policy: BasketPolicy = BasketPolicy()) -> DataFrame:
    """Split one anchor's sales into a wholesale and a fleet basket, per month, without loss."""
    f = facts.filter(F.col("anchor_brand") == policy.anchor)
    ok = (F.lower(F.trim("plc")) == policy.eligible_plc.lower()) & (T.model_year("model_year") == policy.eligible_model_year)
    q, r = F.greatest(F.col("quantity"), F.lit(0.0)), F.greatest(F.col("revenue").cast("double"), F.lit(0.0))
    tot = f.groupBy("month").agg(
        F.sum(r).alias("revenue"), F.sum(q).alias("quantity"),
        F.coalesce(F.sum(F.when(ok, r)), F.lit(0.0)).alias("eligible_revenue"),
        F.coalesce(F.sum(F.when(ok, q)), F.lit(0.0)).alias("eligible_quantity"))
    veh = (wl.filter(F.col("anchor_brand") == policy.anchor).groupBy("month")
           .agg(F.sum("wholesale_units").alias("wv"), F.sum("fleet_units").alias("fv")))
    j = tot.join(veh, "month", "left").withColumns({
        "wholesale_vehicles": T.clip_zero("wv"), "fleet_vehicles": T.clip_zero("fv")}).drop("wv", "fv")
    on = F.col("month") >= policy.effective_month
    fq = F.when(on, F.least("fleet_vehicles", "eligible_quantity")).otherwise(0.0)
    unit = F.when(F.col("eligible_quantity") > 0, F.col("eligible_revenue") / F.col("eligible_quantity")).otherwise(0.0)
    j = j.withColumn("fleet_quantity", fq)
    j = j.withColumn("fleet_revenue", F.when(on, F.least(F.col("fleet_quantity") * unit, "eligible_revenue", "revenue")).otherwise(0.0))
    j = j.withColumns({"wholesale_quantity": F.col("quantity") - F.col("fleet_quantity"),
                       "wholesale_revenue": F.col("revenue") - F.col("fleet_revenue"),
                       "fleet_shortfall": F.when(on, F.greatest(F.col("fleet_vehicles") - F.col("eligible_quantity"), F.lit(0.0))).otherwise(0.0)})
    rd = F.col("revenue") - F.col("wholesale_revenue") - F.col("fleet_revenue")
    qd = F.col("quantity") - F.col("wholesale_quantity") - F.col("fleet_quantity")
    fv0 = F.nullif(F.col("fleet_vehicles"), F.lit(0.0))
    return j.select(
        "month", F.when(on, "separate_wholesale_and_fleet").otherwise("legacy_wholesale_only").alias("contract_mode"),
        "revenue", "quantity", "wholesale_vehicles", "fleet_vehicles", "eligible_revenue", "eligible_quantity",
        "wholesale_revenue", "fleet_revenue", "wholesale_quantity", "fleet_quantity",
        (F.col("wholesale_revenue") / F.nullif(F.col("wholesale_vehicles"), F.lit(0.0))).alias("wholesale_pnvw"),
        (F.col("fleet_revenue") / fv0).alias("fleet_pnvw"),
        F.when(on, F.col("fleet_quantity") / fv0).alias("fleet_penetration"), "fleet_shortfall",
        rd.alias("revenue_delta"), qd.alias("quantity_delta"),
        F.when((F.abs(rd) > 1e-6) | (F.abs(qd) > 1e-6), "reconciliation_error")
        .when(on & (F.col("fleet_shortfall") > 0), "pass_with_fleet_quantity_shortfall")
        .otherwise("pass").alias("status"))


def entity_map(sales: DataFrame) -> DataFrame:
    """One row per brand::model entity: modal name, brands, codes, years, rows."""
    s = sales.select(T.blank("brand").alias("brand"), T.blank("model_name").alias("model_name"),
                     T.blank("model_code").alias("model_code"), T.blank("model_year").alias("model_year"))
    s = s.filter(F.col("model_name") != "")
    return s.groupBy(T.entity_key("model_name", "brand").alias("entity_key")).agg(
        T.mode_text("model_name").alias("model_name"), T.join_unique("brand").alias("brand"),
        T.join_unique("model_code").alias("model_codes"), T.join_unique("model_year").alias("model_years"),
        F.count(F.lit(1)).alias("row_count"))


def lifecycle(sales: DataFrame, *, cutoff_year: int = 2024, gap_months: int = 12, new_months: int = 18) -> DataFrame:
    """Activity status per entity. Rows shrink to entity x month first; the gap window then
    holds one row per active month of one entity."""
    s = sales.select("sale_date", T.blank("model_name").alias("model_name"), T.blank("brand").alias("brand"),
                     T.blank("model_code").alias("model_code"), T.clip_zero(F.col("quantity")).alias("quantity"))
    s = s.filter(F.col("sale_date").isNotNull() & (F.col("model_name") != "") & (F.col("quantity") > 0))
    m = s.groupBy(T.entity_key("model_name", "brand").alias("entity_key"), D.month_of("sale_date").alias("month")).agg(
        T.mode_text("model_name").alias("model_name"), T.mode_text("brand").alias("brand"),
        F.collect_set(F.nullif(F.col("model_code"), F.lit(""))).alias("codes"))
    end = m.agg(F.max("month").alias("data_end"))
    w = Window.partitionBy("entity_key").orderBy("month")
    o = D.month_ord(F.col("month"))
    gap = o - F.lag(o).over(w) - 1
    e = (m.withColumn("gap", gap).groupBy("entity_key").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"),
        F.max_by("month", F.when(F.col("gap").isNotNull(), F.struct(F.col("gap"), -o))).alias("gap_month"),
        F.mode("model_name", True).alias("model_name"), F.mode("brand", True).alias("brand"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))), " / ").alias("model_codes"))
        .crossJoin(F.broadcast(end)))          # end is one row
    le, de, fe = (D.month_ord(F.col(c)) for c in ("last_month", "data_end", "first_month"))
    cutoff = f"{cutoff_year}-12"
    inactive_months = F.greatest(F.lit(0), de - le)
    observed = F.greatest(F.lit(1), de - fe + 1)
    disc = (F.col("last_month") <= cutoff) & (F.col("data_end") > cutoff)
    stopped = (F.substring("data_end", 6, 2) >= "06") & (F.substring("last_month", 1, 4) < F.substring("data_end", 1, 4))
    re_month = F.when(F.col("max_gap") >= gap_months, F.col("gap_month"))
    st = lambda code, label: F.struct(F.lit(code).alias("c"), F.lit(label).alias("s"))
    state = (F.when(disc, st("discontinued", f"Discontinued through {cutoff_year}"))
             .when(stopped, st("inactive", "Inactive before current forecast year"))
             .when(re_month.isNotNull(), st("reintroduced", "Reintroduced"))
             .when(inactive_months >= gap_months, st("inactive", "Inactive"))
             .when(observed < new_months, st("new", "New / limited history"))
             .otherwise(st("active", "Active")))
    return e.withColumn("st", state).select(
        "entity_key", "model_name", T.normalize_name("brand").alias("brand"), "model_codes", "first_month",
        "last_month", F.col("st.s").alias("status"), F.col("st.c").alias("status_code"), disc.alias("discontinued"),
        stopped.alias("inactive_before_year"), re_month.isNotNull().alias("reintroduced"),
        re_month.alias("reintroduced_month"), F.col("max_gap").cast("int").alias("max_gap"),
        inactive_months.cast("int").alias("inactive_months"), observed.cast("int").alias("observed_months"))


def anchor_policy_summary(facts: DataFrame) -> DataFrame:
    """One row per mapping method: rows, quantity, share, and whether it counts as exact."""
    methods = facts.groupBy("anchor_method").agg(F.count(F.lit(1)).alias("row_count"), F.sum("quantity").alias("quantity"))
    return (methods.withColumn("tot", F.sum("quantity").over(Window.partitionBy()))     # a row per method: a fixed few
            .select("anchor_method", "row_count", "quantity",
                    F.col("anchor_method").isin(*EXACT_ANCHOR_METHODS).alias("exact"),
                    F.round(F.col("quantity") / F.nullif(F.col("tot"), F.lit(0.0)) * 100, 2).alias("share_pct")))
