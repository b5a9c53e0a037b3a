"""Queries: composed forecasts (FC20-FC23, FC25, FC26, FC28-FC30, T8, P9 with cutoff)."""

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import forecast as FC
from ..operators import forecasting as FO
from ..operators import moments as M
from ..operators import series as S
from ..session import materialize
from . import inputs as I
from . import series_sql as Q
from .base_sql import block
from .evaluate import OUTER
from .registry import query
from .series import PROFILE, RATED, SELECTED, W4, month_sales

rnd = lambda n, *cols: [F.round(c, n).alias(c) for c in cols]

block("b_volumes", "SELECT part_number, sum(quantity) AS total_quantity FROM b_sales GROUP BY 1")


@query("FC20_part_portfolio", RATED + f""", nx AS (SELECT part_number, h[-1] AS latest, {Q.path_by_name('tr', 'm', 1)}[1] AS nf FROM (SELECT part_number, h, b.train AS tr, b.model AS m FROM ({SELECTED}) WHERE n > 3))
SELECT part_number, n, latest, round(nf, 5) AS next_forecast, risk, code AS regime, b.model AS model, tier, score, total_quantity, total_quantity / (SELECT sum(total_quantity) FROM b_volumes) AS quantity_share
FROM rated JOIN b_volumes USING (part_number) JOIN nx USING (part_number)""")
def fc20(spark, path):
    return FO.portfolio(I.sales(spark, path)).select("part_number", "n", "latest", *rnd(5, "next_forecast"), "risk", "regime", "model", "tier",
                                                     "score", "total_quantity", "quantity_share")


@query("FC20_portfolio_summary", RATED + """, x AS (SELECT *, total_quantity / (SELECT sum(total_quantity) FROM b_volumes) AS share FROM rated JOIN b_volumes USING (part_number))
SELECT count(*) AS scanned, count(*) FILTER (tier = 'planner_ready') AS ready, count(*) FILTER (tier = 'needs_review') AS review, count(*) FILTER (tier = 'do_not_auto_plan') AS stopped,
 round(coalesce(sum(share) FILTER (tier = 'planner_ready'), 0), 6) AS ready_share,
 (SELECT part_number FROM x ORDER BY CASE tier WHEN 'planner_ready' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END, score DESC, total_quantity DESC, part_number LIMIT 1) AS recommended_part FROM x""")
def fc20b(spark, path):
    return FO.portfolio_summary(FO.portfolio(I.sales(spark, path))).withColumn("ready_share", F.round("ready_share", 6))


@query("T8_watchlist", f"""WITH x AS (SELECT part_number, h[-1] AS latest, {Q.path_by_name('tr', 'm', 1)}[1] AS nf, confidence FROM (SELECT *, b.train AS tr, b.model AS m FROM ({PROFILE})))
SELECT part_number, latest, round(nf, 5) AS next_forecast, round((nf - latest) / nullif(latest, 0) * 100, 4) AS delta_pct, confidence FROM x
ORDER BY coalesce(abs((nf - latest) / nullif(latest, 0) * 100), 0) DESC, nf DESC, part_number LIMIT 8""")
def t8(spark, path):
    w = FO.watchlist(I.sales(spark, path))
    return w.select("part_number", "latest", *rnd(5, "next_forecast"), *rnd(4, "delta_pct"), "confidence")


@query("FC22_change_explanation", """WITH p AS (SELECT *, max(sale_date) OVER (PARTITION BY plc) AS last FROM b_sales), s AS (SELECT * FROM p WHERE NOT (last < last_day(last) AND day(last) <= 27 AND month = strftime(last, '%Y-%m'))),
e AS (SELECT plc, month, 'brand' AS dimension, brand AS name, sum(quantity) AS q FROM s GROUP BY ALL UNION ALL SELECT plc, month, 'model_name', model_name, sum(quantity) FROM s GROUP BY ALL),
m AS (SELECT plc, month, row_number() OVER (PARTITION BY plc ORDER BY month DESC) AS k FROM (SELECT DISTINCT plc, month FROM s)),
d AS (SELECT plc, dimension, name, coalesce(sum(q) FILTER (k = 1), 0) AS latest, coalesce(sum(q) FILTER (k = 2), 0) AS previous FROM e JOIN m USING (plc, month) GROUP BY ALL)
SELECT * FROM (SELECT *, latest - previous AS delta, row_number() OVER (PARTITION BY plc, dimension ORDER BY abs(latest - previous) DESC, name) AS position FROM d WHERE latest <> previous) WHERE position <= 5""")
def fc22(spark, path):
    return FO.explain_changes(I.sales(spark, path), "plc", ["brand", "model_name"])


def exposure(spark, path):
    return FO.exposure_model(S.exposure_features(month_sales(spark, path), I.wl(spark, path)))


_EX = ["1", "lag1", "lag2", "rolling3", "exposure", "exposure_change", "time_idx"]
_GOOD = " AND ".join(f"{c} IS NOT NULL" for c in ["actual", *_EX[1:]])
block("b_exf", W4.replace("round(CASE WHEN count(actual) OVER p >= 2 THEN avg(actual) OVER p END, 6)", "CASE WHEN count(actual) OVER p >= 2 THEN avg(actual) OVER p END"))
block("b_exfit", f"""SELECT part_number, month, actual, exposure, greatest({' + '.join(f'w_{i} * {c}' for i, c in enumerate(_EX))}, 0) AS expected,
 w_4 * (exposure - usual) + w_5 * exposure_change AS contribution FROM ({M.solved_sql(
    f"(SELECT *, avg(CASE WHEN {_GOOD} THEN exposure END) OVER (PARTITION BY part_number ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM b_exf)",
    _EX, "actual", _GOOD, "PARTITION BY part_number ORDER BY month", [0.0] + [1.0] * 6)}) WHERE {_GOOD} AND time_idx >= 5 AND rows >= 5""")


@query("FC23_exposure_model", """WITH s AS (SELECT part_number, sum(abs(expected - actual)) / nullif(sum(actual), 0) AS wape, max_by({'m': month, 'a': actual, 'x': exposure, 'e': expected, 'c': contribution}, month) AS l FROM b_exfit GROUP BY 1),
t AS (SELECT part_number, max(month) AS latest, max_by(p, month) AS previous FROM (SELECT *, lag(exposure) OVER (PARTITION BY part_number ORDER BY month) AS p FROM b_exf) GROUP BY 1)
SELECT part_number, round(l.x, 4) AS latest_exposure, round((l.x - previous) / nullif(previous, 0) * 100, 4) AS exposure_delta_pct, round(l.e, 3) AS expected, round(wape, 4) AS wape,
 round((l.a - l.e) / nullif(l.e, 0) * 100, 2) AS residual_pct, round(l.c, 2) AS contribution,
 CASE WHEN wape IS NULL THEN 'Unavailable' WHEN wape <= 0.2 THEN 'Strong' WHEN wape <= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength
FROM s JOIN t USING (part_number) WHERE l.m = latest""")
def fc23(spark, path):
    return exposure(spark, path).select("part_number", *rnd(4, "latest_exposure", "exposure_delta_pct"), *rnd(3, "expected"), *rnd(4, "wape"), *rnd(2, "residual_pct", "contribution"), "strength")


@query("FC21_alerts")
def fc21(spark, path):
    return FO.surfaced(FO.alerts(I.sales(spark, path), exposure(spark, path)))


@query("FC21_alert_summary")
def fc21b(spark, path):
    return FO.alert_summary(FO.alerts(I.sales(spark, path), exposure(spark, path)))


def model_series(spark, path):
    f = I.anchored_sales(spark, path)
    return S.pack(f, ["model_key"], F.col("quantity"), end="2001-10")


@query("F14_series_days", """WITH c AS (SELECT CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, working_days AS w FROM b_cal WHERE month < '2001-01'),
x AS (SELECT part_number, start_ord + i AS o FROM b_pser, range(0, 200) t(i) WHERE i < n + 12)
SELECT part_number, round(sum(coalesce(c.w, y.w)), 5) AS days FROM x LEFT JOIN c USING (o) LEFT JOIN (SELECT o % 12 AS m, avg(w) AS w FROM c GROUP BY 1) y ON y.m = x.o % 12 GROUP BY 1""")
def f14(spark, path):
    cal = I.cal(spark, path).filter("month < '2001-01'")       # later months take the calendar-month mean
    d = FO.with_days(FO.part_series(I.sales(spark, path)), cal, 12)
    return d.select("part_number", F.round(FC.asum(F.col("day_list")), 5).alias("days"))


block("b_mser", """SELECT e.model_key, CAST(min(e.o) AS INT) AS start_ord, list(coalesce(m.q, 0) ORDER BY e.o) AS h, CAST(count(*) AS INT) AS n FROM
 (SELECT model_key, unnest(range(min(o), 2001 * 12 + 10)) AS o FROM (SELECT model_key, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o FROM b_factsraw WHERE month <= '2001-10') GROUP BY 1) e
 LEFT JOIN (SELECT model_key, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, sum(quantity) AS q FROM b_factsraw GROUP BY ALL) m ON e.model_key = m.model_key AND e.o = m.o GROUP BY e.model_key""")


block("b_mrows", """SELECT model_key, n, o, CAST(t AS DOUBLE) AS t, h[t + 1] AS y, (coalesce(c.w, y.w, m.w) - m.w) / greatest(m.w, 1) AS x2, m.w AS mean_days,
 sin(2 * pi() * (o % 12 + 1) / 12) AS x3, cos(2 * pi() * (o % 12 + 1) / 12) AS x4
FROM (SELECT model_key, n, h, t, start_ord + t AS o FROM b_mser, range(0, 400) r(t) WHERE t < n + 3 AND n >= 18) x
LEFT JOIN (SELECT CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, working_days AS w FROM b_cal) c USING (o)
LEFT JOIN (SELECT CAST(substr(month, 6, 2) AS INT) - 1 AS k, avg(working_days) AS w FROM b_cal GROUP BY 1) y ON y.k = x.o % 12, (SELECT avg(working_days) AS w FROM b_cal) m""")
block("b_mfit", M.solved_sql("b_mrows", ["1", "t", "x2", "x3", "x4"], "y", "t < n", "PARTITION BY model_key ORDER BY t"))


@query("FC25_driver_coefficients", """SELECT model_key, u.name AS name, round(u.value, 2) AS value FROM (SELECT model_key, unnest([{'name': 'intercept', 'value': w_0}, {'name': 'trend_per_month', 'value': w_1},
 {'name': 'working_days_ratio', 'value': w_2}, {'name': 'season_sin', 'value': w_3}, {'name': 'season_cos', 'value': w_4}, {'name': 'working_day_effect', 'value': w_2 / greatest(mean_days, 1)},
 {'name': 'seasonal_amplitude', 'value': sqrt(w_3 * w_3 + w_4 * w_4)}]) AS u FROM b_mfit WHERE t = n)""")
def fc25(spark, path):
    return FO.coefficient_rows(FO.driver_forecast(model_series(spark, path), I.cal(spark, path), 3), ["model_key"]).withColumn("value", F.round("value", 2))


@query("FC25_driver_forecast", """WITH p AS (SELECT *, greatest(0, w_0 + w_1 * t + w_2 * x2 + w_3 * x3 + w_4 * x4) AS p, least(6, greatest(3, n // 4)) AS k FROM b_mfit)
SELECT model_key, round(sum(abs(p - y)) FILTER (t >= n - k AND t < n) / nullif(sum(y) FILTER (t >= n - k AND t < n), 0), 4) AS wape,
 round(avg(abs(p - y)) FILTER (t >= n - k AND t < n), 3) AS mae, round(max(p) FILTER (t = n), 3) AS f1, round(max(p) FILTER (t = n + 2), 3) AS f3,
 CAST(count(*) FILTER (t >= n - k AND t < n) AS INT) AS tested FROM p GROUP BY 1""")
def fc25b(spark, path):
    d = FO.driver_forecast(model_series(spark, path), I.cal(spark, path), 3).filter("driver_forecast is not null")
    return d.select("model_key", F.round("driver_wape", 4).alias("wape"), F.round("driver_mae", 3).alias("mae"), F.round(F.get("driver_forecast", 0), 3).alias("f1"),
                    F.round(F.get("driver_forecast", 2), 3).alias("f3"), F.size("driver_outer_pred").alias("tested"))


_AUTO_OUTER = OUTER.replace("b_pser", "hs").replace("SELECT part_number, b.model AS backtest_model,", "SELECT part_number, b.wape AS chosen_wape, b.model AS backtest_model,", 1)


@query("FC26_strategy_auto", f"""WITH hs AS (SELECT model_key AS part_number, start_ord, h, n FROM b_mser), o AS ({_AUTO_OUTER}), s AS (SELECT model_key, {Q.select_best('h')} AS b FROM b_mser),
f AS (SELECT *, n - hold AS split, least(6, greatest(3, (n - hold) // 4)) AS inner_hold FROM (
 SELECT model_key, n, t, y, greatest(0, w_0 + w_1 * t + w_2 * x2 + w_3 * x3 + w_4 * x4) AS p, least(6, greatest(3, n // 4)) AS hold FROM b_mfit WHERE t >= 12 AND t < n)),
d AS (SELECT model_key, sum(abs(p - y)) FILTER (t >= split) / nullif(sum(y) FILTER (t >= split), 0) AS wape, CASE WHEN sum(y) FILTER (t >= split) > 0 THEN sum(abs(p - y)) FILTER (t >= split) / sum(y) FILTER (t >= split) END AS outer_wape,
 CASE WHEN any_value(split) >= 18 THEN sum(abs(p - y)) FILTER (t >= split - inner_hold AND t < split) / nullif(sum(y) FILTER (t >= split - inner_hold AND t < split), 0) END AS split_wape FROM f GROUP BY 1),
j AS (SELECT s.model_key, b, d.* EXCLUDE (model_key), o.backtest_model, CASE WHEN list_sum(act) > 0 THEN list_sum(list_transform(o.p, lambda x, i: abs(x - act[i]))) / list_sum(act) END AS base_outer,
 d.model_key IS NOT NULL AND (b.wape IS NULL OR coalesce(d.wape < b.wape, false)) AS better, split_wape IS NOT NULL AND (chosen_wape IS NULL OR split_wape < chosen_wape) AS outer_better
 FROM s LEFT JOIN d USING (model_key) LEFT JOIN o ON o.part_number = s.model_key)
SELECT model_key, CASE WHEN better THEN 'driver_adjusted_regression' ELSE b.model END AS model, CASE WHEN better THEN 'driver' ELSE 'baseline' END AS note, round(CASE WHEN better THEN wape ELSE b.wape END, 4) AS wape,
 CASE WHEN outer_better THEN 'driver_adjusted_regression' ELSE backtest_model END AS outer_model, round(CASE WHEN outer_better THEN outer_wape ELSE base_outer END, 4) AS outer_wape FROM j""")
def fc26(spark, path):
    r = FO.resolve(model_series(spark, path), I.cal(spark, path), strategy="auto", horizon=3)
    return r.select("model_key", F.col("pick_model").alias("model"), "note", F.round("pick_wape", 4).alias("wape"), F.col("ev_model").alias("outer_model"), F.round("ev_wape", 4).alias("outer_wape"))


@query("FC26_strategy_forced", f"""SELECT model_key, i AS step, round({Q.path('h', 'seasonal_mean', 3)}[i], 5) AS value, 'forced' AS note FROM b_mser, range(1, 4) t(i)""")
def fc26b(spark, path):
    r = FO.resolve(model_series(spark, path), I.cal(spark, path), strategy="seasonal_mean", horizon=3)
    return r.select("model_key", "note", F.posexplode("pick_forecast").alias("i", "v")).select(
        "model_key", (F.col("i") + 1).cast("long").alias("step"), F.round("v", 5).alias("value"), "note")


def center_facts(spark, path):
    """Facts with the governed anchor as brand and anchor::model as entity, and lifecycle."""
    return I.anchored_sales(spark, path).withColumn("brand", F.col("anchor_brand")).withColumn(
        "entity_key", F.concat_ws("::", "anchor_brand", "model_key")).withColumn("lifecycle_status", F.lit("Active"))


@query("FC28_hierarchical_model", f"""WITH s AS (SELECT model_key, h, n, {Q.select_best('h')} AS b FROM b_mser), f AS (SELECT *, {Q.path_by_name('tr', 'm', 3)} AS p FROM (SELECT *, b.train AS tr, b.model AS m FROM s)),
hs AS (SELECT model_key AS part_number, start_ord, h, n FROM b_mser),
o AS ({OUTER.replace('b_pser', 'hs')})
SELECT a.anchor_brand AS brand, f.model_key, b.model AS selected_model, f.n AS history_months, list_sum(f.h) AS history_volume, round(f.p[1] * 0.9::DOUBLE, 5) AS f1, round(f.p[3] * 0.9::DOUBLE, 5) AS f3,
 o.backtest_model, round(list_sum(list_transform(o.p, lambda x, i: abs(x - o.act[i]))) / list_sum(o.act), 5) AS wape
FROM f JOIN b_amap a ON f.model_key = a.model_key JOIN o ON o.part_number = f.model_key""")
def fc28(spark, path):
    r = FO.hierarchical(center_facts(spark, path), I.cal(spark, path), "model", horizon=3, strategy="baseline_auto", tariff_pct=-10.0, min_volume=0.0)
    return r.select("brand", F.upper("model_name").alias("model_key"), "selected_model", "history_months", "history_volume", F.round(F.get("forecast", 0), 5).alias("f1"),
                    F.round(F.get("forecast", 2), 5).alias("f3"), "backtest_model", F.round("wape", 5).alias("wape"))


@query("FC28_hierarchical_part")
def fc28b(spark, path):
    f = center_facts(spark, path).select("month", *FO.LEVEL_KEYS["model_accessory"], "part_description", "lifecycle_status", "quantity")
    r = FO.hierarchical(materialize(f), I.cal(spark, path), "model_accessory", horizon=3)           # read for the cutoff, the series and the names
    return FO.hierarchical_summary(r)


@query("FC28_hierarchical_brand_auto")
def fc28c(spark, path):
    r = FO.hierarchical(center_facts(spark, path), I.cal(spark, path), "brand", horizon=6, value="revenue")
    return FO.forecast_long(r, ["brand"])


@query("FC29_part_payload", f"""SELECT part_number, month, 'actual' AS kind, value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM b_pdense JOIN (SELECT part_number FROM b_pser WHERE n > 3) USING (part_number)
UNION ALL SELECT part_number, printf('%04d-%02d', (start_ord + n - 1 + i) // 12, (start_ord + n - 1 + i) % 12 + 1), 'forecast', round(v, 5), round(greatest(0, v - s), 5), round(v + s, 5) FROM (
 SELECT *, greatest(b.mae, v * 0.12) * sqrt(i) * 1.28 AS s FROM (SELECT *, p[i] AS v FROM (SELECT *, {Q.path_by_name('tr', 'm', 3)} AS p FROM (SELECT *, b.train AS tr, b.model AS m FROM ({SELECTED}) WHERE n > 3)), range(1, 4) t(i)))""")
def fc29(spark, path):
    p = FO.part_payload(FO.part_series(I.sales(spark, path)))
    return p.select("part_number", "month", "kind", *rnd(5, "value", "lower", "upper"))


@query("FC30_nowcast", f"""WITH d AS (SELECT max(sale_date) AS d FROM b_sales), f AS (SELECT entity AS brand, k AS horizon, printf('%04d-%02d', (2001 * 12 + 9 + k) // 12, (2001 * 12 + 9 + k) % 12 + 1) AS month, {Q.path('h', 'trailing_12_mean', 3)}[k] AS baseline FROM b_aser, range(1, 4) t(k)),
n AS (SELECT strftime(d, '%Y-%m') AS now_month, d < last_day(d) AS open, (SELECT count(*) FROM range(1, 32) t(i) WHERE i <= day(d) AND isodow(CAST(strftime(d, '%Y-%m') || '-01' AS DATE) + (i - 1)::INT) <= 5) / (SELECT working_days FROM b_cal WHERE month = strftime(d, '%Y-%m')) AS completion FROM d),
m AS (SELECT anchor_brand AS brand, month, sum(quantity) AS atd FROM b_factsraw GROUP BY ALL)
SELECT f.brand, CAST(f.horizon AS INT) AS horizon, f.month, CASE WHEN f.month = now_month AND open THEN 'Nowcast' ELSE 'Forecast' END AS forecast_type,
 round(CASE WHEN f.month = now_month AND open THEN greatest(0, coalesce(atd, 0) + (1 - completion) * baseline) ELSE baseline END, 5) AS value, CASE WHEN f.month = now_month AND open THEN coalesce(atd, 0) END AS actual_to_date
FROM f CROSS JOIN n LEFT JOIN m ON f.brand = m.brand AND f.month = m.month""")
def fc30(spark, path):
    facts = center_facts(spark, path)
    a = S.pack(facts, ["brand"], F.col("quantity"), end="2001-10").select(
        "brand", "start_ord", F.col("n").alias("history_months"), FC.path(F.col("h"), "trailing_12_mean", 3).alias("forecast"))
    latest = I.sales(spark, path).agg(F.max("sale_date").alias("latest_date"))
    n = FO.nowcast(FO.forecast_long(a, ["brand"]), facts, latest, I.cal(spark, path))
    return n.select("brand", "horizon", "month", "forecast_type", F.round("value", 5).alias("value"), "actual_to_date")
