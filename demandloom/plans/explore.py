"""Queries: filters, facets, pivots, profiles, charts, joins of sales and vehicles."""

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import explore as X
from ..sources import planning as P
from . import inputs as I
from .registry import query

FILTERS = X.Filters(search="anvil", brand=("H", "G"), model_year=("1998", "1999"), model_query="B", start_date="1997-01-01",
                    end_date="2000-12-31")
FSQL = dict(
    base="sale_date >= DATE '1997-01-01' AND sale_date <= DATE '2000-12-31' AND contains(lower(model_name), 'b') AND "
         "contains(lower(concat_ws(' ', brand, model_name, part_number, part_description, model_code, plc)), 'anvil')",
    brand="brand IN ('H', 'G')", year="model_year IN ('1998', '1999')")
ROW = "CAST(sale_date AS VARCHAR) AS sale_date, brand, model_name, model_year, part_number, quantity, CAST(revenue AS DOUBLE) AS revenue"


def _row(df):
    return df.select(F.col("sale_date").cast("string").alias("sale_date"), "brand", "model_name", "model_year", "part_number",
                     "quantity", F.col("revenue").cast("double").alias("revenue"))


@query("P1_P2_facet_filter", f"SELECT {ROW} FROM b_sales WHERE {FSQL['base']} AND {FSQL['brand']} AND {FSQL['year']}")
def p1(spark, path):
    return _row(X.apply_filters(I.sales(spark, path, model_year=True), FILTERS))


@query("P2_free_text_search", """SELECT brand, model_name, plc, count(*) AS n FROM b_sales
WHERE contains(lower(concat_ws(' ', brand, model_name, part_number, part_description, model_code, plc)), 'ring')
  AND contains(lower(concat_ws(' ', brand, model_name, part_number, part_description, model_code, plc)), '12') GROUP BY ALL""")
def p2(spark, path):
    cols = ["brand", "model_name", "part_number", "part_description", "model_code", "plc"]
    return (I.sales(spark, path).filter(X.search_condition("Ring 12", cols)).groupBy("brand", "model_name", "plc")
            .agg(F.count(F.lit(1)).alias("n")))


@query("P3_date_range_end_of_day", """SELECT event_type, count(*) AS n, CAST(min(ts) AS VARCHAR) IS NOT NULL AS has_min FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-10 23:59:59' GROUP BY event_type""")
def p3(spark, path):
    e = P.table(spark, path, "events", "ts", "event_type")
    return (X.date_range_inclusive(e, "2024-01-03", "2024-01-10", "ts").groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").isNotNull().alias("has_min")))


@query("P4_facet_columns", """
SELECT col AS column, n AS distinct_values, n > 1 AND n <= 40 AS reasonable FROM (
  UNPIVOT (SELECT count(DISTINCT brand) AS brand, count(DISTINCT model_name) AS model_name, count(DISTINCT model_code) AS model_code,
    count(DISTINCT plc) AS plc, count(DISTINCT part_number) AS part_number, count(DISTINCT model_year) AS model_year FROM b_sales)
  ON brand, model_name, model_code, plc, part_number, model_year INTO NAME col VALUE n)""")
def p4(spark, path):
    cols = ["brand", "model_name", "model_code", "plc", "part_number", "model_year"]
    p = X.column_profile(I.sales(spark, path, model_year=True), {c: "text" for c in cols})
    return p.select("column", F.col("distinct").alias("distinct_values"), F.col("distinct").between(2, 40).alias("reasonable"))


@query("P5_planning_source_filter", """
WITH f AS (SELECT * FROM b_factsraw WHERE anchor_brand = 'HMA' OR brand = 'K'),
f2 AS (SELECT * FROM f WHERE (part_number IN ('12', '77') OR plc IN ('PROMO', 'SMALL')) AND month >= '1998-02' AND month <= '2000-03')
SELECT 'facts' AS side, anchor_brand, month, sum(quantity) AS quantity FROM f2 GROUP BY ALL
UNION ALL SELECT 'wholesale', anchor_brand, month, sum(wholesale_units) FROM b_wl
WHERE (anchor_brand = 'HMA' OR anchor_brand IN (SELECT anchor_brand FROM f)) AND month >= '1998-02' AND month <= '2000-03' GROUP BY ALL""")
def p5(spark, path):
    f, w = X.filter_planning_sources(I.facts(spark, path), I.wl(spark, path), brand=("HMA", "K"), part=("12", "77", "PROMO", "SMALL"),
                                     start="1998-02-10", end="2000-03-31")
    a = f.groupBy("anchor_brand", "month").agg(F.sum("quantity").alias("quantity")).withColumn("side", F.lit("facts"))
    b = w.groupBy("anchor_brand", "month").agg(F.sum("wholesale_units").alias("quantity")).withColumn("side", F.lit("wholesale"))
    return a.unionByName(b)


@query("P6_total_label", """SELECT count(*) FILTER (regexp_matches(lower(text), '\\btotal\\b')) AS totals, count(*) AS n FROM documents""")
def p6(spark, path):
    d = P.table(spark, path, "documents", "text")
    return d.agg(F.count_if(T.is_total(F.col("text"))).alias("totals"), F.count(F.lit(1)).alias("n"))


@query("P8_P12_cutoff_context", """
SELECT CAST(d AS VARCHAR) AS latest_date, 'none' AS requested, d >= last_day(d) AS latest_complete, CAST(d AS VARCHAR) AS effective_date,
  CASE WHEN d >= last_day(d) THEN strftime(d, '%Y-%m') ELSE strftime(d - INTERVAL 1 MONTH, '%Y-%m') END AS cutoff_month
FROM (SELECT max(sale_date) AS d FROM b_sales)
UNION ALL SELECT CAST(max(sale_date) AS VARCHAR), '2000-05-10', true, '2000-05-31', '2000-05' FROM b_sales""")
def p8(spark, path):
    s = I.sales(spark, path)
    return X.cutoff_context(s).withColumn("requested", F.lit("none")).unionByName(
        X.cutoff_context(s, "2000-05-10").withColumn("requested", F.lit("2000-05-10")))


@query("P9_volume_completeness", """
WITH m AS (SELECT month, sum(quantity) AS q FROM b_factsraw GROUP BY month), t AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS k FROM m)
SELECT (SELECT month FROM t WHERE k = 1) AS latest_month, (SELECT q FROM t WHERE k = 1) AS latest_quantity, med AS prior_median,
  (SELECT q FROM t WHERE k = 1) / nullif(med, 0) AS ratio, coalesce((SELECT q FROM t WHERE k = 1) / nullif(med, 0) >= 0.9, true) AS supports_complete
FROM (SELECT median(q) AS med FROM t WHERE k BETWEEN 2 AND 4)""")
def p9(spark, path):
    return X.volume_completeness(I.facts(spark, path))


@query("P10_partial_part_month", """
SELECT part_number, count(*) AS n, sum(quantity) AS quantity, CAST(max(sale_date) AS VARCHAR) AS last_date
FROM (SELECT *, max(sale_date) OVER (PARTITION BY part_number) AS last FROM b_sales)
WHERE NOT (last < last_day(last) AND day(last) <= 27 AND month = strftime(last, '%Y-%m')) GROUP BY part_number""")
def p10(spark, path):
    return (X.drop_partial_part_months(I.sales(spark, path)).groupBy("part_number")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.max("sale_date").cast("string").alias("last_date")))


@query("P13_display_values", """SELECT coalesce(model_year, '') AS model_year, coalesce(brand, '') AS brand, count(*) AS n FROM b_sales GROUP BY ALL""")
def p13(spark, path):
    s = I.sales(spark, path, model_year=True)
    return s.groupBy(X.dimension("model_year").alias("model_year"), X.dimension("brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("A8_kpis", """SELECT count(*) AS row_count, sum(quantity) AS quantity, CAST(sum(revenue) AS DOUBLE) AS revenue,
  count(DISTINCT part_number) AS parts FROM b_sales""")
def a8(spark, path):
    return X.kpis(I.sales(spark, path))


TYPES = {"sale_date": "date", "brand": "text", "model_name": "text", "model_code": "text", "model_year": "text",
         "part_number": "text", "part_description": "text", "plc": "text", "quantity": "numeric"}
ROLE_OF = {"sale_date": "date", "brand": "brand", "model_name": "model", "model_year": "model_year", "part_number": "part_number",
           "part_description": "part_description", "plc": "plc", "quantity": "installation_quantity"}
_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 1) AS missing_pct,
  count(DISTINCT {c}) AS "distinct", (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM b_sales
  WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS samples FROM b_sales""" for c, t in TYPES.items())


@query("A9_column_profile", _PROFILE)
def a9(spark, path):
    return X.column_profile(I.sales(spark, path, model_year=True), TYPES)


@query("A11_field_classification", """SELECT * FROM (VALUES ('sale_date','date','Time','High'), ('brand','brand','Vehicle','High'),
 ('model_name','model','Vehicle','High'), ('model_code','','Vehicle','Medium'), ('model_year','model_year','Vehicle','High'),
 ('part_number','part_number','Part','High'), ('part_description','part_description','Part','High'), ('plc','plc','Part','High'),
 ('quantity','installation_quantity','Quantity','High')) t("column", role, field_group, confidence)""")
def a11(spark, path):
    return X.classify_fields(X.column_profile(I.sales(spark, path, model_year=True), TYPES), ROLE_OF)


_LEAD = """
SELECT * FROM (SELECT 'brand' AS kind, brand AS name, CAST(sum(revenue) AS DOUBLE) AS value, 'revenue' AS metric FROM b_sales GROUP BY brand ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'model', model_name, CAST(sum(revenue) AS DOUBLE), 'revenue' FROM b_sales GROUP BY model_name ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'part', part_description, sum(quantity), 'quantity' FROM b_sales GROUP BY part_description ORDER BY 3 DESC, 2 LIMIT 1)"""


@query("A10_leaders", _LEAD)
def a10(spark, path):
    return X.leaders(I.sales(spark, path))


@query("A10_slice_stats", """SELECT CAST(sum(revenue) AS DOUBLE) / sum(quantity) AS unit_price, sum(quantity) / count(*) AS qty_per_row,
  CAST(sum(revenue) AS DOUBLE) / count(*) AS revenue_per_row, 100.0::DOUBLE AS completeness FROM b_sales""")
def a10b(spark, path):
    return X.slice_stats(I.sales(spark, path), ["sale_date", "brand", "model_name", "part_number", "quantity", "revenue"])


@query("A12_overview", """SELECT count(*) AS row_count, CAST(min(sale_date) AS VARCHAR) AS min_date, CAST(max(sale_date) AS VARCHAR) AS max_date,
 count(DISTINCT model_name) AS models, count(DISTINCT model_code) AS model_codes, count(DISTINCT part_number) AS parts, count(DISTINCT brand) AS brands,
 CAST(sum(revenue) AS DOUBLE) AS revenue, sum(quantity) AS quantity FROM b_sales""")
def a12(spark, path):
    return X.overview(I.sales(spark, path))


QCOLS = {"date": "sale_date", "brand": "brand", "model": "model_name", "part_number": "part_number"}


@query("A13_missing_and_sign", """
SELECT "check", "rows", round("rows" * 100.0 / n, 2) AS pct FROM (UNPIVOT (SELECT count(*) AS n,
  count(*) FILTER (sale_date IS NULL) AS date, count(*) FILTER (coalesce(trim(brand), '') = '') AS brand,
  count(*) FILTER (coalesce(trim(model_name), '') = '') AS model, count(*) FILTER (coalesce(trim(part_number), '') = '') AS part_number,
  count(*) FILTER (revenue < 0) AS negative_revenue, count(*) FILTER (quantity < 0) AS negative_quantity, count(*) FILTER (quantity = 0) AS zero_quantity FROM b_sales)
  ON date, brand, model, part_number, negative_revenue, negative_quantity, zero_quantity INTO NAME "check" VALUE "rows")""")
def a13(spark, path):
    return X.data_quality(I.sales(spark, path), QCOLS)


@query("A13_unit_price_outliers", """
WITH p AS (SELECT CAST(revenue AS DOUBLE) / nullif(quantity, 0) AS p FROM b_sales), b AS (SELECT quantile_cont(p, 0.01) AS lo, quantile_cont(p, 0.99) AS hi FROM p)
SELECT round(lo, 6) AS p01, round(hi, 6) AS p99, (SELECT count(*) FROM p, b WHERE p.p < b.lo OR p.p > b.hi) AS outliers FROM b""")
def a13b(spark, path):
    o = X.unit_price_outliers(I.sales(spark, path))
    return o.select(F.round("p01", 6).alias("p01"), F.round("p99", 6).alias("p99"), "outliers")


@query("A14_description_conflicts", """
WITH d AS (SELECT l_shipdate, part_number, CASE WHEN l_linestatus = 'F' THEN upper(part_description) WHEN l_returnflag = 'R' THEN part_description || ' kit' ELSE part_description END AS raw
  FROM lineitem JOIN b_part ON l_partkey = p_partkey)
SELECT part_number, CASE WHEN count(DISTINCT lower(raw)) > 1 THEN 'description_mismatch' ELSE 'format_warning' END AS issue,
  count(DISTINCT lower(raw)) AS description_count, count(DISTINCT raw) AS variant_count, count(*) AS row_count,
  array_to_string(list_slice(list_sort(list_distinct(list(raw))), 1, 5), ' | ') AS descriptions
FROM d GROUP BY part_number HAVING count(DISTINCT raw) > 1
ORDER BY issue, description_count DESC, row_count DESC, part_number LIMIT 10""")
def a14(spark, path):
    l = P.table(spark, path, "lineitem", "l_partkey", "l_linestatus", "l_returnflag")
    p = P._parts(spark, path).select("p_partkey", "part_number", "part_description")
    raw = (F.when(F.col("l_linestatus") == "F", F.upper("part_description"))
           .when(F.col("l_returnflag") == "R", F.concat("part_description", F.lit(" kit"))).otherwise(F.col("part_description")))
    return X.description_conflicts(l.join(p, F.col("l_partkey") == F.col("p_partkey")).select("part_number", raw.alias("part_description")))


@query("A15_correlation", """SELECT round(corr(revenue, wholesale_units), 3) AS correlation, count(*) AS pairs FROM (
 SELECT s.month, CAST(sum(revenue) AS DOUBLE) AS revenue, any_value(w.u) AS wholesale_units FROM b_sales s JOIN
 (SELECT month, sum(wholesale_units) AS u FROM b_wl GROUP BY month) w ON s.month = w.month WHERE s.month < (SELECT max(month) FROM b_sales) GROUP BY s.month)""")
def a15(spark, path):
    m = X.monthly_full(I.sales(spark, path), I.wl(spark, path))
    # months with vehicles only carry revenue 0 in the full outer table: keep months that sold
    return X.revenue_wholesale_correlation(m.filter("quantity > 0"))


@query("A16_ambiguous_codes", """SELECT code, count(*) AS model_count, string_agg(model, ' / ' ORDER BY model) AS models FROM
 (SELECT DISTINCT upper(model_code) AS code, upper(model_name) AS model FROM b_sales) GROUP BY code HAVING count(*) > 1""")
def a16(spark, path):
    return X.ambiguous_codes(I.sales(spark, path))


_SRC = """s AS (SELECT s.brand, s.model_name, s.month, s.model_year, s.sale_date, s.quantity, s.revenue,
  coalesce(a.anchor_brand, CASE WHEN s.brand = 'K' THEN 'KUS' ELSE 'HMA' END) AS anchor_brand, coalesce(a.method, 'x') AS anchor_method
  FROM b_sales s LEFT JOIN b_amap a USING (model_key))"""


@query("J9_A17_source_anchor_summary", f"""WITH {_SRC} SELECT brand, anchor_brand, sum(quantity) AS quantity, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM s WHERE month = (SELECT max(month) FROM s) GROUP BY ALL""")
def a17(spark, path):
    return X.source_anchor_summary(X.source_anchor_rows(I.sales(spark, path, model_year=True), I.facts(spark, path)))


@query("J9_A17_source_anchor_models", f"""WITH {_SRC} SELECT anchor_brand, model_name, anchor_method,
  string_agg(DISTINCT model_year, ' / ' ORDER BY model_year) AS model_years, string_agg(DISTINCT month[1:4], ' / ' ORDER BY month[1:4]) AS sales_years,
  CAST(min(sale_date) AS VARCHAR) AS first_sale, CAST(max(sale_date) AS VARCHAR) AS last_sale,
  coalesce(sum(quantity) FILTER (month = (SELECT max(month) FROM s)), 0) AS latest_quantity, sum(quantity) AS quantity, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM s WHERE brand = 'H' GROUP BY ALL""")
def a17b(spark, path):
    return X.source_anchor_models(X.source_anchor_rows(I.sales(spark, path, model_year=True), I.facts(spark, path)), "H")


@query("A18_monthly_trend", """SELECT f.month, CAST(f.revenue AS DOUBLE) AS revenue, f.quantity, w.units AS wholesale_units,
  CAST(f.revenue AS DOUBLE) / nullif(w.units, 0) AS pnvw FROM (SELECT month, sum(revenue) AS revenue, sum(quantity) AS quantity FROM b_factsraw GROUP BY month) f
  LEFT JOIN (SELECT month, sum(wholesale_units) AS units FROM b_wl GROUP BY month) w USING (month)""")
def a18(spark, path):
    f = I.facts(spark, path, model_year=True).groupBy("month").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").alias("quantity"))
    w = I.wl(spark, path).groupBy("month").agg(F.sum("wholesale_units").alias("wholesale_units"))
    return f.join(w, "month", "left").withColumn("pnvw", F.col("revenue") / F.nullif(F.col("wholesale_units"), F.lit(0.0)))


@query("A18_A33_monthly_charts", """SELECT month, sum(quantity) AS quantity, CAST(sum(revenue) AS DOUBLE) AS revenue FROM b_sales GROUP BY month""")
def a33(spark, path):
    s = I.sales(spark, path)
    return X.monthly_trend(s, "quantity").join(X.monthly_trend(s, "revenue"), "month")


@query("A19_chart_median_by_quarter", """SELECT CAST(CAST(date_trunc('quarter', sale_date) AS DATE) AS VARCHAR) AS bucket, brand AS color, median(quantity) AS value
FROM b_sales GROUP BY ALL""")
def a19(spark, path):
    return X.chart_table(I.sales(spark, path), D.bucket("sale_date", "Quarter"), F.col("quantity"), "median", F.col("brand"))


@query("A19_chart_average_top_models", """WITH g AS (SELECT model_name AS bucket, plc AS color, sum(quantity) / count(*) AS value FROM b_sales GROUP BY ALL)
SELECT bucket, color, value FROM g WHERE bucket IN (SELECT bucket FROM g GROUP BY bucket ORDER BY round(sum(value), 6) DESC, bucket LIMIT 5)""")
def a19b(spark, path):
    return X.chart_table(I.sales(spark, path), F.col("model_name"), F.col("quantity"), "average", F.col("plc"), top_n=5)


def _pivot_sql(r, c, v, agg, src="b_sales"):
    return f"""SELECT CASE WHEN gr = 0 AND gc = 0 THEN 'cell' WHEN gr = 0 THEN 'row_total' WHEN gc = 0 THEN 'col_total' ELSE 'grand_total' END AS level,
  coalesce(rk, '') AS row_key, coalesce(ck, '') AS col_key, round(v, 2) AS value FROM (
  SELECT rk, ck, grouping(rk) AS gr, grouping(ck) AS gc, {agg} AS v FROM (SELECT {r} AS rk, {c} AS ck, {v} AS v FROM {src})
  GROUP BY GROUPING SETS ((rk, ck), (rk), (ck), ()))"""


@query("A20_pivot_sum", _pivot_sql("brand || ' / ' || model_name", "model_year", "quantity", "sum(v)"))
def a20(spark, path):
    s = I.sales(spark, path, model_year=True)
    return X.pivot(s, [X.dimension("brand"), X.dimension("model")], [X.dimension("model_year")], X.measure("quantity"))


@query("A20_A34_pivot_avg", _pivot_sql("month", "brand", "quantity", "sum(v) / count(v)"))
def a20b(spark, path):
    return X.pivot(I.sales(spark, path), [X.dimension("month")], [X.dimension("brand")], X.measure("quantity"), "avg")


@query("A20_A34_pivot_records", _pivot_sql("year(sale_date)::VARCHAR", "'Total'", "1.0", "count(v)::DOUBLE"))
def a20c(spark, path):
    return X.pivot(I.sales(spark, path), [X.dimension("year")], [], X.measure("records"), "count")


@query("A20_pivot_capped", f"""WITH p AS ({_pivot_sql('part_description', 'brand', 'quantity', 'sum(v)')}),
k AS (SELECT row_key FROM p WHERE level = 'row_total' ORDER BY value DESC, row_key LIMIT 20)
SELECT * FROM p WHERE level IN ('grand_total', 'col_total') OR row_key IN (SELECT row_key FROM k)""")
def a20d(spark, path):
    return X.pivot(I.sales(spark, path), [X.dimension("part")], [X.dimension("brand")], X.measure("quantity"), max_rows=20)


@query("A22_facet_options", f"""
WITH c AS (
 SELECT 'brand' AS facet, brand AS value, count(*) AS n, 25 AS lim FROM b_sales WHERE {FSQL['base']} AND {FSQL['year']} GROUP BY ALL
 UNION ALL SELECT 'model', model_name, count(*), 80 FROM b_sales WHERE {FSQL['base']} AND {FSQL['year']} AND {FSQL['brand']} GROUP BY ALL
 UNION ALL SELECT 'model_year', model_year, count(*), 20 FROM b_sales WHERE {FSQL['base']} AND {FSQL['brand']} GROUP BY ALL
 UNION ALL SELECT 'part', part_description, count(*), 120 FROM b_sales WHERE {FSQL['base']} AND {FSQL['year']} AND {FSQL['brand']} GROUP BY ALL)
SELECT facet, value, n, position FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'model_year' THEN 0 ELSE -n END, value) AS position FROM c)
WHERE position <= lim""")
def a22(spark, path):
    return X.facet_options(I.sales(spark, path, model_year=True), FILTERS)


@query("A23_part_options", """SELECT part_number, count(*) AS n, sum(quantity) AS quantity, min(part_description) AS description
FROM b_sales GROUP BY part_number ORDER BY quantity DESC, n DESC, part_number LIMIT 120""")
def a23(spark, path):
    return X.part_options(I.sales(spark, path))


@query("A24_insights", f"""
SELECT 'date_coverage' AS insight, CAST(min(sale_date) AS VARCHAR) || ' to ' || CAST(max(sale_date) AS VARCHAR) AS subject, NULL::DOUBLE AS value FROM b_sales
UNION ALL SELECT 'rows_with_quantity', '', round(count(*) FILTER (quantity > 0) * 100.0 / count(*), 4) FROM b_sales
UNION ALL SELECT 'top_' || kind, name, value FROM ({_LEAD}) WHERE kind <> 'brand'""")
def a24(spark, path):
    return X.insights(I.sales(spark, path))


@query("A31_date_summary", """SELECT CAST(min(sale_date) AS VARCHAR) AS min_date, CAST(max(sale_date) AS VARCHAR) AS max_date, count(DISTINCT month) AS active_months,
  CAST(min(year(sale_date)) AS INT) AS start_year FROM b_sales""")
def a31(spark, path):
    return X.date_summary(I.sales(spark, path))


def _top(name, metric, n):
    return f"SELECT {name} AS name, CAST(sum({metric}) AS DOUBLE) AS value FROM b_sales GROUP BY 1 ORDER BY value DESC, name LIMIT {n}"


@query("T1_top_models", _top("model_name", "revenue", 10))
def t1(spark, path):
    return X.top_groups(I.sales(spark, path), F.col("model_name"), "revenue", 10)


@query("T2_top_parts_labelled", _top("part_number || ' - ' || part_description", "revenue", 10))
def t2(spark, path):
    return X.top_groups(I.sales(spark, path), X.part_label(), "revenue", 10)


@query("T3_A33_top_parts_chart", _top("part_description", "revenue", 12))
def t3(spark, path):
    return X.top_groups(I.sales(spark, path), F.col("part_description"), "revenue", 12)


@query("S12_T4_table_page", f"""SELECT {ROW}, (SELECT count(*) FROM b_sales) AS total_rows FROM b_sales ORDER BY quantity DESC NULLS LAST, revenue DESC, part_number, sale_date,
 brand, model_year OFFSET 100 LIMIT 50""")
def s12(spark, path):
    s = I.sales(spark, path, model_year=True)
    total = s.agg(F.count(F.lit(1)).alias("total_rows"))
    page = X.table_page(s, [F.col("quantity").desc_nulls_last(), F.col("revenue").desc_nulls_last(), F.col("part_number").asc(),
                            F.col("sale_date").asc(), F.col("brand").asc(), F.col("model_year").asc()], 3, 50)
    return _row(page).crossJoin(F.broadcast(total))


@query("J5_monthly_full_outer", """
SELECT month, coalesce(revenue, 0) AS revenue, coalesce(quantity, 0) AS quantity, u AS wholesale_units, coalesce(revenue, 0) / nullif(u, 0) AS pnvw
FROM (SELECT month, CAST(sum(revenue) AS DOUBLE) AS revenue, sum(quantity) AS quantity FROM b_sales GROUP BY month) s
FULL JOIN (SELECT month, sum(wholesale_units) AS u FROM b_wl GROUP BY month) w USING (month) WHERE month < (SELECT max(month) FROM b_sales)""")
def j5(spark, path):
    return X.monthly_full(I.sales(spark, path), I.wl(spark, path))


@query("J6_monthly_inner", """
SELECT month, u AS wholesale_units, CASE WHEN u = 0 THEN 0 ELSE revenue / u END AS pnvw
FROM (SELECT month, CAST(sum(revenue) AS DOUBLE) AS revenue FROM b_sales GROUP BY month) s
JOIN (SELECT month, sum(wholesale_units) AS u FROM b_wl GROUP BY month) w USING (month) WHERE month < (SELECT max(month) FROM b_sales)""")
def j6(spark, path):
    return X.monthly_inner(I.sales(spark, path), I.wl(spark, path))


_SLICE = """s AS (SELECT DISTINCT upper(model_name) AS mk, upper(model_code) AS ck FROM b_sales WHERE plc = 'PROMO' AND brand = 'H'),
w0 AS (SELECT * FROM b_whrows)"""


@query("J7_wholesale_for_slice", f"""WITH {_SLICE}, u AS (SELECT upper(model_code) AS ck FROM w0 GROUP BY 1 HAVING min(model_name) = max(model_name))
SELECT month, model_name, model_code, sum(units) AS units FROM w0 WHERE upper(model_name) IN (SELECT mk FROM s)
 OR upper(model_code) IN (SELECT ck FROM s WHERE mk NOT IN (SELECT upper(model_name) FROM w0) AND ck IN (SELECT ck FROM u)) GROUP BY ALL""")
def j7(spark, path):
    s = I.sales(spark, path).filter("plc = 'PROMO' and brand = 'H'")
    w = P.wholesale_rows(spark, path)
    return X.wholesale_for_slice(s, w).groupBy("month", "model_name", "model_code").agg(F.sum("units").alias("units"))


@query("J8_R4_match_coverage", f"""WITH {_SLICE}, a AS (SELECT DISTINCT upper(model_name) AS v FROM b_sales), b AS (SELECT DISTINCT upper(model_name) AS v FROM w0)
SELECT (SELECT count(*) FROM a WHERE v IN (SELECT v FROM b)) AS matched, (SELECT count(*) FROM a) AS sales_values, (SELECT count(*) FROM b) AS wholesale_values,
 round((SELECT count(*) FROM a WHERE v IN (SELECT v FROM b)) * 100.0 / (SELECT count(*) FROM a), 2) AS coverage_pct""")
def j8(spark, path):
    w = P.wholesale_rows(spark, path)
    return X.match_coverage(I.sales(spark, path), w, "model_name")


@query("J8_R4_unmatched_values", f"""WITH {_SLICE}, p0 AS (SELECT part_number, CASE WHEN cast(part_number AS varchar) LIKE '%7' THEN 'NEW ' || model_name ELSE model_name END AS model_name FROM b_part),
x AS (SELECT upper(model_name) AS value, part_number AS rid FROM p0 WHERE upper(model_name) NOT IN (SELECT upper(model_name) FROM w0)),
k AS (SELECT DISTINCT value FROM x ORDER BY value LIMIT 10)
SELECT value, array_to_string(list_slice(list_sort(list(rid)), 1, 5), ',') AS "rows" FROM x WHERE value IN (SELECT value FROM k) GROUP BY value""")
def j8b(spark, path):
    w = P.wholesale_rows(spark, path)
    renamed = F.when(F.col("part_number").cast("string").endswith("7"), F.concat(F.lit("NEW "), "model_name")).otherwise(F.col("model_name"))
    return X.unmatched_values(P._parts(spark, path).withColumn("model_name", renamed), w, "model_name", "part_number")


@query("R5_distinct_pairs", """SELECT DISTINCT upper(model_code) AS code, upper(model_name) AS model FROM b_sales""")
def r5(spark, path):
    return I.sales(spark, path).select(F.upper("model_code").alias("code"), T.normalize_name("model_name").alias("model")).dropDuplicates()
