"""Queries: planning-record reports."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import report as R
from . import inputs as I
from .base_sql import block
from .registry import query

THROUGH, NOW, NEXT = "2001-05", "2001-06", "2001-07"
ANCHORS = ("HMA", "GMA", "KUS")
D2 = lambda *cs: [F.round(c, 5).alias(c) for c in cs]


def points(spark, path):
    """brand x plc x model x month revenue, with the fleet component named where it applies."""
    f = I.anchored_sales(spark, path)
    comp = F.when((F.col("anchor_brand") == "KUS") & (F.col("plc") == "PROMO"), R.FLEET).otherwise("regular")
    return f.groupBy("month", F.col("anchor_brand").alias("brand"), "plc", "model_name", comp.alias("component")).agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").alias("quantity"))


def actuals(spark, path):
    return points(spark, path).filter(F.col("month") <= THROUGH)


def plan(spark, path):
    """Plan rows after the cutoff: nine tenths of what was sold; the open month also has nowcast rows."""
    p = points(spark, path).filter((F.col("month") > THROUGH) & (F.col("month") <= "2001-10"))
    fc = p.withColumns({"record_type": F.lit("forecast_brand_plc"), "revenue": F.col("revenue") * 0.9, "period_type": F.lit("forecast")})
    nc = p.filter(F.col("month") == NOW).withColumns({"record_type": F.lit("nowcast_brand_plc"), "period_type": F.lit("nowcast")})
    return fc.unionByName(nc)


def forecast_only(spark, path):
    return plan(spark, path).filter("record_type = 'forecast_brand_plc'")


block("b_pt", f"""SELECT month, anchor_brand AS brand, plc, model_name, CASE WHEN anchor_brand = 'KUS' AND plc = 'PROMO' THEN '{R.FLEET}' ELSE 'regular' END AS component,
 CAST(sum(revenue) AS DOUBLE) AS revenue, sum(quantity) AS quantity FROM b_factsraw GROUP BY ALL""")
block("b_act", f"SELECT * FROM b_pt WHERE month <= '{THROUGH}'")
block("b_plan", f"""SELECT month, brand, plc, model_name, component, revenue * 0.9::DOUBLE AS revenue, quantity, 'forecast_brand_plc' AS record_type, 'forecast' AS period_type FROM b_pt WHERE month > '{THROUGH}' AND month <= '2001-10'
 UNION ALL SELECT month, brand, plc, model_name, component, revenue, quantity, 'nowcast_brand_plc', 'nowcast' FROM b_pt WHERE month = '{NOW}'""")
block("b_fplan", "SELECT * FROM b_plan WHERE record_type = 'forecast_brand_plc'")
block("b_land", "SELECT * FROM b_plan p WHERE record_type LIKE 'nowcast%' OR month NOT IN (SELECT month FROM b_plan WHERE record_type LIKE 'nowcast%')")


def _movers(src, keep="rank <= 5"):
    return f"""WITH g AS (SELECT brand, plc, month, sum(revenue) AS revenue FROM {src} GROUP BY ALL), m AS (SELECT month AS target_month, lag(month) OVER (ORDER BY month) AS comparison_month FROM (SELECT DISTINCT month FROM g)),
 j AS (SELECT comparison_month, target_month, a.brand, a.plc, a.revenue AS b, c.revenue AS t, c.revenue - a.revenue AS ch FROM m JOIN g a ON a.month = m.comparison_month JOIN g c ON c.month = m.target_month AND a.brand = c.brand AND a.plc = c.plc WHERE abs(c.revenue - a.revenue) > 1e-9),
 k AS (SELECT *, CASE WHEN ch > 0 THEN 'upside' ELSE 'downside' END AS direction, row_number() OVER (PARTITION BY target_month, ch > 0 ORDER BY abs(ch) DESC, brand, plc) AS rank FROM j)
 SELECT comparison_month, target_month, brand, plc, direction, CAST(rank AS INT) AS rank, round(ch, 5) AS change, round(CASE WHEN b > 0 THEN ch / b END, 6) AS change_pct FROM k WHERE {keep}"""


def _mv(df):
    return df.select("comparison_month", "target_month", "brand", "plc", "direction", "rank", *D2("change"), F.round("change_pct", 6).alias("change_pct"))


@query("V1_J14_W12_actual_movers", _movers("b_act"))
def v1(spark, path):
    return _mv(R.actual_movers(actuals(spark, path)))


@query("V2_bridge_movers", f"""WITH b AS (SELECT brand, plc, sum(revenue) AS b FROM b_act WHERE month = '{THROUGH}' GROUP BY ALL), t AS (SELECT brand, plc, sum(revenue) AS t FROM b_fplan WHERE month = '{NOW}' GROUP BY ALL),
k AS (SELECT *, t - b AS ch, row_number() OVER (PARTITION BY t > b ORDER BY abs(t - b) DESC, brand, plc) AS rank FROM b JOIN t USING (brand, plc))
SELECT '{NOW}' AS target_month, brand, plc, CASE WHEN ch > 0 THEN 'upside' ELSE 'downside' END AS direction, CAST(rank AS INT) AS rank, round(ch, 5) AS change FROM k WHERE rank <= 5""")
def v2(spark, path):
    return R.bridge_movers(actuals(spark, path), forecast_only(spark, path), THROUGH).select("target_month", "brand", "plc", "direction", "rank", *D2("change"))


@query("V3_forecast_movers", _movers("b_fplan"))
def v3(spark, path):
    return _mv(R.forecast_movers(forecast_only(spark, path)))


@query("V3_comparison_counts", """WITH g AS (SELECT brand, plc, month, sum(revenue) AS revenue FROM b_fplan GROUP BY ALL), m AS (SELECT month AS target_month, lag(month) OVER (ORDER BY month) AS comparison_month FROM (SELECT DISTINCT month FROM g)),
x AS (SELECT m.comparison_month, m.target_month, k.brand, k.plc, a.revenue AS b, c.revenue AS t FROM m CROSS JOIN (SELECT DISTINCT brand, plc FROM g) k LEFT JOIN g a ON a.month = m.comparison_month AND a.brand = k.brand AND a.plc = k.plc
 LEFT JOIN g c ON c.month = m.target_month AND c.brand = k.brand AND c.plc = k.plc WHERE m.comparison_month IS NOT NULL AND (a.revenue IS NOT NULL OR c.revenue IS NOT NULL))
SELECT comparison_month, target_month, count(*) AS candidates, count(*) FILTER (b IS NOT NULL AND t IS NOT NULL) AS matched, count(*) FILTER (b IS NULL OR t IS NULL) AS unmatched, count(*) FILTER (t - b > 1e-9) AS upside,
 count(*) FILTER (t - b < -1e-9) AS downside, count(*) FILTER (abs(t - b) <= 1e-9) AS zero_change, count(*) FILTER (t IS NOT NULL AND b <= 0) AS nonpositive_base FROM x GROUP BY ALL""")
def v3b(spark, path):
    return R.comparison_counts(forecast_only(spark, path))


@query("T7_overview_movers", f"""WITH v AS ({_movers('b_act')}), p AS (SELECT *, row_number() OVER (PARTITION BY comparison_month, target_month ORDER BY abs(change) DESC, direction DESC, rank) AS position FROM v)
SELECT target_month, brand, plc, direction, change, CAST(position AS INT) AS position FROM p WHERE position <= 5""")
def t7(spark, path):
    m = R.overview_movers(R.actual_movers(actuals(spark, path)), ["comparison_month", "target_month"])
    return m.select("target_month", "brand", "plc", "direction", *D2("change"), "position")


@query("P11_landing_rows", "SELECT month, record_type, count(*) AS n, round(sum(revenue), 5) AS revenue FROM b_land GROUP BY ALL")
def p11(spark, path):
    return R.landing_rows(plan(spark, path)).groupBy("month", "record_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("revenue"), 5).alias("revenue"))


@query("T6_top_plcs_by_brand", f"""WITH r AS (SELECT plc, CASE WHEN component = '{R.FLEET}' THEN 'Fleet' ELSE brand END AS stack, revenue FROM b_fplan WHERE month = '{NEXT}'), k AS (SELECT plc, sum(revenue) AS total FROM r GROUP BY plc ORDER BY total DESC, plc LIMIT 6)
SELECT plc, stack, round(total, 5) AS total, round(sum(revenue), 5) AS revenue FROM r JOIN k USING (plc) GROUP BY ALL""")
def t6(spark, path):
    return R.ranked_plcs(forecast_only(spark, path), NEXT).select("plc", "stack", *D2("total", "revenue"))


@query("T6_top_models", f"""SELECT brand, model_name, round(sum(revenue), 5) AS revenue FROM b_act WHERE month = '{THROUGH}' AND component <> '{R.FLEET}' GROUP BY ALL ORDER BY sum(revenue) DESC, brand, model_name LIMIT 6""")
def t6b(spark, path):
    return R.ranked_models(actuals(spark, path), THROUGH).select("brand", "model_name", *D2("revenue"))


@query("R6_planning_months", f"""SELECT month, CASE WHEN month IN (SELECT month FROM b_act) THEN 'actual' WHEN month = '{NOW}' THEN 'original_forecast' ELSE 'forecast' END AS period FROM (SELECT month FROM b_act UNION SELECT month FROM b_plan)""")
def r6(spark, path):
    return R.planning_months(actuals(spark, path), plan(spark, path), "2001-06-20")


def wholesale_records(spark, path):
    w = I.wl(spark, path).groupBy("month", F.col("anchor_brand").alias("brand")).agg(F.sum("wholesale_units").alias("u"), F.sum("fleet_units").alias("fl"))
    src = F.when(F.col("u") % 3 == 0, "sponsor_plan_official+internal_forecast_fallback").when(F.col("u") % 3 == 1, "sponsor_plan_official")
    return w.select("month", "brand", F.when(F.col("u") % 5 != 0, F.col("u")).alias("selected"), F.when(F.col("u") % 10 != 0, F.col("u") + 1).alias("forecast_wholesale"),
                    F.col("fl").alias("sponsor_plan"), (F.col("u") + F.col("fl")).alias("internal"), src.alias("source"), (F.col("u") % 3).alias("fallback_models"))


block("b_whrec", """SELECT month, anchor_brand AS brand, sum(wholesale_units) AS u, sum(fleet_units) AS fl FROM b_wl GROUP BY ALL""")


@query("V4_F18_F20_wholesale_summary", """WITH r AS (SELECT month, brand, coalesce(CASE WHEN u % 5 <> 0 THEN u END, CASE WHEN u % 10 <> 0 THEN u + 1 END) AS selected, fl AS sponsor_plan, u + fl AS internal,
 CASE WHEN u % 3 = 0 THEN 'Sponsor Plan + Internal fallback' WHEN u % 3 = 1 THEN 'Sponsor Plan only' ELSE 'Unavailable' END AS source, u % 3 AS fallback_models FROM b_whrec),
x AS (SELECT m.month, b.brand, r.selected, r.sponsor_plan, r.internal, coalesce(r.source, 'Unavailable') AS source, r.fallback_models FROM (SELECT DISTINCT month FROM r) m CROSS JOIN (SELECT DISTINCT brand FROM b_whrec) b LEFT JOIN r USING (month, brand))
SELECT x.*, CASE WHEN count(selected) OVER w = 3 THEN sum(selected) OVER w END AS total_selected, CASE WHEN count(fallback_models) OVER w = 3 THEN count(*) FILTER (fallback_models > 0) OVER w END AS brands_using_fallback FROM x WINDOW w AS (PARTITION BY month)""")
def v4(spark, path):
    r = wholesale_records(spark, path)
    return R.wholesale_summary(r, r.select("brand").distinct())


def totals(spark, path):
    p = plan(spark, path)
    return p.withColumn("record_type", F.when(F.col("record_type").startswith("nowcast"), "nowcast_total").otherwise("forecast_total"))


@query("V5_revenue_trend", f"""WITH f AS (SELECT month, sum(revenue) AS f FROM b_fplan GROUP BY month ORDER BY month LIMIT 6), n AS (SELECT month, sum(revenue) AS n FROM b_plan WHERE record_type LIKE 'nowcast%' GROUP BY month)
SELECT month, round(coalesce(n, f), 5) AS value, CASE WHEN n IS NOT NULL THEN 'nowcast' ELSE 'forecast' END AS period_type, CASE WHEN row_number() OVER (ORDER BY month) <= 3 THEN 'Primary' ELSE 'Exploratory' END AS horizon FROM f LEFT JOIN n USING (month)""")
def v5(spark, path):
    return R.revenue_trend(totals(spark, path), NOW).withColumn("value", F.round("value", 5))


@query("V6_brand_trend", """WITH l AS (SELECT month, 'actual' AS period_type, brand, revenue FROM b_act UNION ALL SELECT month, period_type, brand, revenue FROM b_land)
SELECT month, period_type, round(sum(revenue) FILTER (brand = 'HMA'), 5) AS "HMA", round(sum(revenue) FILTER (brand = 'GMA'), 5) AS "GMA", round(sum(revenue) FILTER (brand = 'KUS'), 5) AS "KUS", round(sum(revenue), 5) AS total FROM l GROUP BY ALL""")
def v6(spark, path):
    a = actuals(spark, path).select("month", F.lit("actual").alias("period_type"), "brand", "revenue")
    t = R.brand_trend(a.unionByName(R.landing_rows(plan(spark, path)).select("month", "period_type", "brand", "revenue")), ANCHORS)
    return t.select("month", "period_type", *D2(*ANCHORS, "total"))


@query("V6_brand_snapshots", f"""WITH c AS (SELECT brand, sum(revenue) AS c FROM b_land WHERE month = '{NOW}' GROUP BY 1), p AS (SELECT brand, sum(revenue) AS p FROM b_act WHERE month = '{THROUGH}' GROUP BY 1), n AS (SELECT brand, sum(revenue) AS n FROM b_land WHERE month = '{NEXT}' GROUP BY 1)
SELECT brand, round(c, 5) AS current_value, round(p, 5) AS previous_value, round(c - p, 5) AS change_value, round((c - p) / p, 6) AS change_pct, round(n, 5) AS next_value FROM c FULL JOIN p USING (brand) FULL JOIN n USING (brand)""")
def v6b(spark, path):
    s = R.brand_snapshots(actuals(spark, path), R.landing_rows(plan(spark, path)), NOW, THROUGH, NEXT)
    return s.select("brand", *D2("current_value", "previous_value", "change_value", "next_value"), F.round("change_pct", 6).alias("change_pct"))


@query("V7_F19_pnvw_history", f"""WITH v AS (SELECT month, anchor_brand AS brand, sum(wholesale_units) AS d FROM b_wl GROUP BY ALL), n AS (SELECT month, brand, sum(revenue) AS n FROM b_pt GROUP BY ALL)
SELECT month, brand, CASE WHEN month = '{NOW}' THEN 'nowcast' ELSE 'actual' END AS period_type, round(n, 5) AS numerator, d AS denominator, round(n / nullif(d, 0), 4) AS pnvw,
 CASE WHEN n / nullif(d, 0) IS NOT NULL THEN 'available' ELSE 'x' END AS state FROM n JOIN v USING (month, brand) WHERE month IN ('2001-04', '{THROUGH}', '{NOW}')""")
def v7(spark, path):
    w = I.wl(spark, path).groupBy("month", F.col("anchor_brand").alias("brand")).agg(F.sum("wholesale_units").alias("denominator"))
    num = lambda d: d.groupBy("month", "brand").agg(F.sum("revenue").alias("numerator")).join(w, ["month", "brand"])
    now = plan(spark, path).filter("period_type = 'nowcast'")
    h = R.pnvw_history(num(actuals(spark, path)), num(now), ANCHORS)
    return h.select("month", "brand", "period_type", *D2("numerator"), "denominator", F.round("pnvw", 4).alias("pnvw"),
                    T.pnvw_state(F.col("pnvw"), F.col("denominator"), F.lit("regular")).alias("state"))


_EXEC = f"""SELECT brand, v AS value, p AS premonth, v - p AS change, CASE WHEN p > 0 THEN (v - p) / p END AS change_pct, v / sum(v) OVER () AS share FROM (SELECT brand, sum(revenue) AS v FROM b_land WHERE month = '{NOW}' GROUP BY 1)
 LEFT JOIN (SELECT brand, sum(revenue) AS p FROM b_fplan WHERE month = '{NOW}' GROUP BY 1) USING (brand)"""


def executive(spark, path):
    return R.executive_view(R.landing_rows(plan(spark, path)), forecast_only(spark, path), NOW)


@query("V8_executive_view", f"SELECT brand, round(value, 5) AS value, round(premonth, 5) AS premonth, round(change, 5) AS change, round(change_pct, 6) AS change_pct, round(share, 6) AS share FROM ({_EXEC})")
def v8(spark, path):
    return executive(spark, path).select("brand", *D2("value", "premonth", "change"), F.round("change_pct", 6).alias("change_pct"), F.round("share", 6).alias("share"))


@query("V9_brand_drivers", f"""SELECT brand, round(change, 5) AS original_forecast_change, u AS wholesale, round(u / sum(u) OVER (), 6) AS volume_share, round(value / u, 4) AS pnvw FROM ({_EXEC}) JOIN (SELECT brand, u FROM b_whrec WHERE month = '{NOW}') USING (brand)""")
def v9(spark, path):
    w = I.wl(spark, path).withColumn("brand", F.col("anchor_brand"))
    d = R.brand_drivers(executive(spark, path), w, NOW)
    return d.select("brand", *D2("original_forecast_change"), "wholesale", F.round("volume_share", 6).alias("volume_share"), F.round("pnvw", 4).alias("pnvw"))


@query("V10_component_split", f"""SELECT month, brand, coalesce(sum(quantity) FILTER (component <> '{R.FLEET}'), 0) AS regular, coalesce(sum(quantity) FILTER (component = '{R.FLEET}'), 0) AS fleet FROM b_fplan GROUP BY ALL""")
def v10(spark, path):
    return R.component_split(forecast_only(spark, path), F.col("quantity"), ["month", "brand"])


@query("F19_pnvw_states", """SELECT CASE WHEN event_type = 'error' THEN 'Fleet component' WHEN value > 20 THEN 'available' WHEN event_id % 2 = 0 THEN 'Selected Wholesale = 0' ELSE 'Selected Wholesale unavailable' END AS state, count(*) AS n FROM events GROUP BY 1""")
def f19(spark, path):
    from ..sources.planning import table
    e = table(spark, path, "events", "event_id", "event_type", "value")
    st = T.pnvw_state(F.when(F.col("value") > 20, F.col("value")), F.when(F.col("event_id") % 2 == 0, F.lit(0.0)), F.when(F.col("event_type") == "error", R.FLEET))
    return e.groupBy(st.alias("state")).agg(F.count(F.lit(1)).alias("n"))
