"""Queries: fact table, wholesale, anchors, baskets, entities, lifecycle."""

from pyspark.sql import functions as F

from ..config import BasketPolicy
from ..functions import dates as D
from ..functions import text as T
from ..operators import facts as FA
from ..sources import planning as P
from . import inputs as I
from .registry import query

dbl = lambda c: F.col(c).cast("double").alias(c)


@query("S6_sales_source", """
SELECT CAST(sale_date AS VARCHAR) AS sale_date, brand, model_name, model_code, model_year, part_number, plc,
  count(*) AS n, sum(quantity) AS quantity, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM b_sales GROUP BY ALL""")
def s6(spark, path):
    s = I.sales(spark, path, model_year=True)
    return (s.groupBy(F.col("sale_date").cast("string").alias("sale_date"), "brand", "model_name", "model_code",
                      "model_year", "part_number", "plc")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"),
                 F.sum("revenue").cast("double").alias("revenue")))


@query("A1_monthly_facts", """
SELECT month, brand, anchor_brand, anchor_method, entity_key, model_key, model_name, model_code, model_year, plc,
  part_number, part_description, quantity, CAST(revenue AS DOUBLE) AS revenue, source_rows FROM b_factsraw""")
def a1(spark, path):
    return I.facts(spark, path, model_year=True).select(
        "month", "brand", "anchor_brand", "anchor_method", "entity_key", "model_key", "model_name", "model_code",
        "model_year", "plc", "part_number", "part_description", "quantity", dbl("revenue"), "source_rows")


@query("J1_J2_A2_fact_ratios", """
SELECT month, brand, entity_key, model_year, plc, part_number, wholesale_units, fleet_units, working_days,
  units_per_vehicle, pnvw, pnvw AS revenue_per_vehicle, qty_per_working_day FROM b_facts""")
def j1(spark, path):
    return I.facts(spark, path, model_year=True).select(
        "month", "brand", "entity_key", "model_year", "plc", "part_number", "wholesale_units", "fleet_units",
        "working_days", "units_per_vehicle", "pnvw", "revenue_per_vehicle", "qty_per_working_day")


@query("J1_wholesale_without_anchor", """
SELECT f.month, f.model_key, sum(f.quantity) AS quantity, max(w.wholesale_units) AS wholesale_units
FROM b_factsraw f LEFT JOIN (SELECT month, model_key, sum(wholesale_units) AS wholesale_units FROM b_wl GROUP BY ALL) w
  USING (month, model_key) GROUP BY ALL""")
def j1b(spark, path):
    f = I.facts(spark, path).select("month", "anchor_brand", "model_key", "quantity").groupBy("month", "model_key").agg(
        F.sum("quantity").alias("quantity"))
    return FA.join_wholesale(f, I.wl(spark, path), use_anchor=False).select(
        "month", "model_key", "quantity", "wholesale_units")


LIFE_SQL = """
SELECT entity_key, model_name, brand, model_codes, first_month, last_month,
  CASE WHEN disc THEN 'Discontinued through 2000' WHEN stopped THEN 'Inactive before current forecast year'
    WHEN reintroduced THEN 'Reintroduced' WHEN inactive_months >= 12 THEN 'Inactive'
    WHEN observed_months < 18 THEN 'New / limited history' ELSE 'Active' END AS status,
  CASE WHEN disc THEN 'discontinued' WHEN stopped THEN 'inactive' WHEN reintroduced THEN 'reintroduced'
    WHEN inactive_months >= 12 THEN 'inactive' WHEN observed_months < 18 THEN 'new' ELSE 'active' END AS status_code,
  disc AS discontinued, stopped AS inactive_before_year, reintroduced,
  CASE WHEN reintroduced THEN gap_month END AS reintroduced_month, max_gap, inactive_months, observed_months
FROM (SELECT *, max_gap >= 12 AS reintroduced, last_month <= '2000-12' AND data_end > '2000-12' AS disc,
    substr(data_end, 6, 2) >= '06' AND substr(last_month, 1, 4) < substr(data_end, 1, 4) AS stopped,
    greatest(0, eo - lo) AS inactive_months, greatest(1, eo - fo + 1) AS observed_months
  FROM (SELECT entity_key, min(model_name) AS model_name, min(brand) AS brand,
      max(codes) AS model_codes,
      min(month) AS first_month, max(month) AS last_month, min(o) AS fo, max(o) AS lo, coalesce(max(gap), 0) AS max_gap,
      arg_max(month, (gap, -o)) FILTER (gap IS NOT NULL) AS gap_month, max(data_end) AS data_end, max(eo) AS eo
    FROM (SELECT *, o - lag(o) OVER (PARTITION BY entity_key ORDER BY o) - 1 AS gap,
        max(month) OVER () AS data_end, max(o) OVER () AS eo
      FROM (SELECT {key} AS entity_key, {name} AS model_name, {brand} AS brand, month,
          CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o
        FROM b_sales WHERE quantity > 0 GROUP BY ALL)) m
      JOIN (SELECT {key} AS entity_key, string_agg(DISTINCT model_code, ' / ' ORDER BY model_code) AS codes
        FROM b_sales WHERE quantity > 0 GROUP BY ALL) USING (entity_key) GROUP BY entity_key))"""


@query("H1_W7_lifecycle", LIFE_SQL.format(key="entity_key", name="model_name", brand="brand"))
def h1(spark, path):
    return FA.lifecycle(I.sales(spark, path), cutoff_year=2000)


# the same operator over individual parts, which have real gaps, late starts and early ends
@query("H1_W7_lifecycle_parts", LIFE_SQL.format(
    key="(brand || '::' || part_number)", name="part_number", brand="brand"))
def h1b(spark, path):
    s = I.sales(spark, path).withColumn("model_name", F.col("part_number"))
    return FA.lifecycle(s, cutoff_year=2000)


@query("J3_facts_lifecycle", """
SELECT f.month, f.entity_key, coalesce(l.status, 'Unknown') AS lifecycle_status, coalesce(l.status_code, 'unknown') AS lifecycle_code,
  sum(f.quantity) AS quantity FROM b_factsraw f LEFT JOIN (""" + LIFE_SQL.format(
    key="entity_key", name="model_name", brand="brand") + """) l USING (entity_key) GROUP BY ALL""")
def j3(spark, path):
    return (I.facts(spark, path, lifecycle=True)
            .groupBy("month", "entity_key", "lifecycle_status", "lifecycle_code").agg(F.sum("quantity").alias("quantity")))


@query("A3_fact_summary", """
SELECT count(*) AS row_count, count(DISTINCT month) AS month_count, min(month) AS min_month, max(month) AS max_month,
  count(DISTINCT brand) AS brand_count, count(DISTINCT anchor_brand) AS anchor_count, count(DISTINCT entity_key) AS model_count,
  count(DISTINCT plc) AS plc_count, count(DISTINCT part_number) AS part_count, sum(quantity) AS total_quantity,
  CAST(sum(revenue) AS DOUBLE) AS total_revenue,
  round(coalesce(sum(CASE WHEN anchor_method IN ('dealer_wholesale_exact','dealer_wholesale_volume_resolved','dealer_wholesale_variant_alias','source_brand_kus') THEN quantity END) / nullif(sum(quantity), 0) * 100, 0), 2) AS exact_quantity_pct,
  round(avg(CASE WHEN wholesale_units IS NOT NULL THEN 100.0 ELSE 0.0 END), 2) AS wholesale_coverage_pct,
  round(avg(CASE WHEN working_days IS NOT NULL THEN 100.0 ELSE 0.0 END), 2) AS working_days_coverage_pct FROM b_facts""")
def a3(spark, path):
    return FA.fact_summary(I.facts(spark, path, model_year=True))


@query("A4_anchor_map", "SELECT model_key, anchor_brand, method, candidates, units FROM b_amap")
def a4(spark, path):
    return FA.anchor_map(I.wl(spark, path))


# customers' market segments give names with and without the power-train suffixes
@query("A4_F4_anchor_aliases", """
SELECT month, upper(anchor_brand) AS anchor_brand, model_key AS name,
  array_to_string(list_sort(list_distinct([model_key, regexp_replace(model_key, '\\bHYBRID\\b', 'HEV', 'g'),
    regexp_replace(regexp_replace(model_key, '\\bHYBRID\\b', 'HEV', 'g'), '\\s+(EV|HEV|PHEV)$', '')])), '|') AS aliases
FROM (SELECT month, anchor_brand, model_key || CASE anchor_brand WHEN 'HMA' THEN ' HYBRID' WHEN 'GMA' THEN ' EV' ELSE '' END AS model_key FROM b_wl)""")
def f4(spark, path):
    suffix = F.when(F.col("anchor_brand") == "HMA", " HYBRID").when(F.col("anchor_brand") == "GMA", " EV").otherwise("")
    n = F.concat("model_key", suffix)
    return I.wl(spark, path).select("month", "anchor_brand", n.alias("name"),
                                    F.array_join(F.array_sort(T.model_aliases(n)), "|").alias("aliases"))


@query("J4_sales_anchor", """
SELECT s.brand, s.model_key, coalesce(a.anchor_brand, CASE WHEN s.brand = 'K' THEN 'KUS' ELSE 'HMA' END) AS anchor_brand,
  coalesce(a.method, CASE WHEN s.brand = 'K' THEN 'source_brand_kus' ELSE 'hma_default_fallback' END) AS anchor_method,
  count(*) AS n FROM b_sales s LEFT JOIN b_amap a USING (model_key)
GROUP BY ALL""")
def j4(spark, path):
    amap = FA.anchor_map(I.wl(spark, path))
    s = I.sales(spark, path).groupBy("brand", T.normalize_name("model_name").alias("model_key")).agg(
        F.count(F.lit(1)).alias("n"))
    return FA.assign_anchor(s, amap).select("brand", "model_key", "anchor_brand", "anchor_method", "n")


BASKET = BasketPolicy(anchor="KUS", effective_month="2000-06", eligible_plc="standard", eligible_model_year="2000")


@query("A5_channel_baskets", """
SELECT month, CASE WHEN gov THEN 'separate_wholesale_and_fleet' ELSE 'legacy_wholesale_only' END AS contract_mode,
  round(revenue, 4) AS revenue, quantity, wv AS wholesale_vehicles, fv AS fleet_vehicles, round(er, 4) AS eligible_revenue, eq AS eligible_quantity,
  round(revenue - fr, 4) AS wholesale_revenue, round(fr, 4) AS fleet_revenue, quantity - fq AS wholesale_quantity, fq AS fleet_quantity,
  round((revenue - fr) / nullif(wv, 0), 4) AS wholesale_pnvw, round(fr / nullif(fv, 0), 4) AS fleet_pnvw,
  CASE WHEN gov THEN round(fq / nullif(fv, 0), 6) END AS fleet_penetration,
  CASE WHEN gov THEN greatest(fv - eq, 0) ELSE 0 END AS fleet_shortfall,
  CASE WHEN gov AND fv > eq THEN 'pass_with_fleet_quantity_shortfall' ELSE 'pass' END AS status
FROM (SELECT *, CASE WHEN gov THEN least(fq * CASE WHEN eq > 0 THEN er / eq ELSE 0 END, er, revenue) ELSE 0 END AS fr
  FROM (SELECT *, month >= '2000-06' AS gov, CASE WHEN month >= '2000-06' THEN least(fv, eq) ELSE 0 END AS fq
    FROM (SELECT f.*, coalesce(v.wv, 0) AS wv, coalesce(v.fv, 0) AS fv FROM (
        SELECT month, CAST(sum(revenue) AS DOUBLE) AS revenue, sum(quantity) AS quantity,
          CAST(coalesce(sum(revenue) FILTER (lower(plc) = 'standard' AND model_year = '2000'), 0) AS DOUBLE) AS er,
          coalesce(sum(quantity) FILTER (lower(plc) = 'standard' AND model_year = '2000'), 0) AS eq
        FROM b_factsraw WHERE anchor_brand = 'KUS' GROUP BY month) f
      LEFT JOIN (SELECT month, sum(wholesale_units) AS wv, sum(fleet_units) AS fv FROM b_wl WHERE anchor_brand = 'KUS' GROUP BY month) v USING (month))))""")
def a5(spark, path):
    b = FA.channel_baskets(I.facts(spark, path, model_year=True), I.wl(spark, path), BASKET)
    r4 = ["revenue", "eligible_revenue", "wholesale_revenue", "fleet_revenue", "wholesale_pnvw", "fleet_pnvw"]
    return b.drop("revenue_delta", "quantity_delta").withColumns(
        {c: F.round(c, 4) for c in r4} | {"fleet_penetration": F.round("fleet_penetration", 6)})


@query("A6_working_days", """
SELECT month, max(n) AS working_days FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, day(o_orderdate) AS n FROM orders
  WHERE isodow(o_orderdate) <= 5) GROUP BY month""")
def a6(spark, path):
    o = P.table(spark, path, "orders", "o_orderdate").filter(F.weekday("o_orderdate") < 5)
    raw = o.select(F.date_format("o_orderdate", "yyyyMM").alias("period"),
                   F.dayofmonth("o_orderdate").cast("string").alias("working day"))
    return FA.working_days(raw, "period", "working day").select("month", F.col("working_days").cast("long").alias("working_days"))


@query("A7_entity_map", """
SELECT entity_key, min(model_name) AS model_name, min(brand) AS brand,
  string_agg(DISTINCT model_code, ' / ' ORDER BY model_code) AS model_codes,
  string_agg(DISTINCT model_year, ' / ' ORDER BY model_year) AS model_years, count(*) AS row_count FROM b_sales GROUP BY entity_key""")
def a7(spark, path):
    return FA.entity_map(I.sales(spark, path, model_year=True))


@query("A27_anchor_policy_summary", """
SELECT anchor_method, count(*) AS row_count, sum(quantity) AS quantity, anchor_method <> 'hma_default_fallback' AS exact,
  round(sum(quantity) / (SELECT sum(quantity) FROM b_factsraw) * 100, 2) AS share_pct FROM b_factsraw GROUP BY anchor_method""")
def a27(spark, path):
    return FA.anchor_policy_summary(I.facts(spark, path, model_year=True))


@query("R3_wholesale_union", """
SELECT month, anchor_brand, model_key, min(brand) AS brand, min(model_name) AS model_name,
  string_agg(DISTINCT codes, ' / ' ORDER BY codes) AS model_code,
  sum(CASE WHEN channel = 'wholesale' THEN units ELSE 0 END) AS wholesale_units,
  sum(CASE WHEN channel = 'fleet' THEN units ELSE 0 END) AS fleet_units,
  string_agg(DISTINCT label, ' / ' ORDER BY label) AS channel,
  string_agg(DISTINCT sheet, ' / ' ORDER BY sheet) AS source_sheet
FROM (SELECT month, brand AS anchor_brand, upper(model_name) AS model_key, brand, model_name, channel,
    string_agg(DISTINCT model_code, ' / ' ORDER BY model_code) AS codes, sum(units) AS units,
    CASE WHEN channel = 'fleet' THEN 'Fleet' ELSE 'Dealer / non-fleet' END AS label,
    CASE WHEN channel = 'fleet' THEN 'fleet' ELSE 'dealer' END AS sheet FROM b_whrows GROUP BY ALL) GROUP BY ALL""")
def r3(spark, path):
    rows = P.wholesale_rows(spark, path)
    dealer = FA.wholesale_long(rows.filter("channel = 'wholesale'"), source="dealer")
    fleet = FA.wholesale_long(rows.filter("channel = 'fleet'"), source="fleet")
    return FA.union_wholesale([dealer, fleet])


@query("F3_anchor_label", """
SELECT brand, part_number, CASE WHEN brand = 'K' THEN 'KUS' WHEN brand = 'H' THEN 'HMA' ELSE '' END AS by_source, anchor AS by_label FROM b_part""")
def f3(spark, path):
    p = P._parts(spark, path)
    label = F.when(F.col("brand") == "H", "Hyundai").when(F.col("brand") == "G", " genesis  cars").otherwise("Kia")
    return p.select("brand", "part_number", T.anchor_label(F.lit(""), F.col("model_name"), F.col("brand")).alias("by_source"),
                    T.anchor_label(label, F.col("model_name"), F.lit("")).alias("by_label"))
