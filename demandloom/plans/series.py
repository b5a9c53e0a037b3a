"""Queries: dense series, window features and every baseline method (W*, FC1-FC19, FC24)."""

from pyspark.sql import functions as F

from ..config import BASELINE_MODELS
from ..functions import dates as D
from ..functions import forecast as FC
from ..functions import kernel as K
from ..operators import explore as X
from ..operators import facts as FA
from ..operators import forecasting as FO
from ..operators import series as S
from . import inputs as I
from . import series_sql as Q
from .registry import query


def part_series(spark, path):
    s = X.drop_partial_part_months(I.sales(spark, path)).withColumn("month", D.month_of("sale_date"))
    return S.pack(s, ["part_number"], F.col("quantity"))


def part_long(spark, path):
    return S.unpack(S.dealt(part_series(spark, path), ["part_number"]), ["part_number"])


@query("W1_dense_series", "SELECT part_number, month, value FROM b_pdense")
def w1(spark, path):
    return part_long(spark, path)


@query("W2_anomalies", """
WITH m AS (SELECT *, CASE WHEN count(value) OVER w >= 3 THEN median(value) OVER w END AS baseline, count(*) OVER (PARTITION BY part_number) AS len FROM b_pdense
  WINDOW w AS (PARTITION BY part_number ORDER BY o ROWS 5 PRECEDING)),
r AS (SELECT *, abs(value - baseline) AS resid FROM m),
s AS (SELECT *, coalesce(resid / nullif(CASE WHEN count(resid) OVER w >= 3 THEN median(resid) OVER w END, 0), 0) AS score FROM r WINDOW w AS (PARTITION BY part_number ORDER BY o ROWS 5 PRECEDING))
SELECT part_number, month, value AS actual, baseline, (value - baseline) / nullif(baseline, 0) * 100 AS delta_pct, score,
  CASE WHEN score >= 3.5 THEN 'High' ELSE 'Medium' END AS severity FROM s WHERE score >= 2 AND len >= 5""")
def w2(spark, path):
    return S.anomalies_long(part_long(spark, path), ["part_number"])


@query("W2_anomalies_top", """
WITH m AS (SELECT *, CASE WHEN count(value) OVER w >= 3 THEN median(value) OVER w END AS baseline, count(*) OVER (PARTITION BY part_number) AS len FROM b_pdense
  WINDOW w AS (PARTITION BY part_number ORDER BY o ROWS 5 PRECEDING)),
r AS (SELECT *, abs(value - baseline) AS resid FROM m),
s AS (SELECT *, coalesce(resid / nullif(CASE WHEN count(resid) OVER w >= 3 THEN median(resid) OVER w END, 0), 0) AS score FROM r WINDOW w AS (PARTITION BY part_number ORDER BY o ROWS 5 PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY score DESC, o) AS k FROM s WHERE score >= 2 AND len >= 5)
SELECT part_number, month, value AS actual, score FROM k WHERE k <= 4""")
def w2b(spark, path):
    p = part_series(spark, path).select("part_number", "start_ord", F.explode(K.anomalies_of(F.col("h"), 4)).alias("a"))
    return p.select("part_number", D.month_from_ord(F.col("start_ord") + F.col("a.position")).alias("month"),
                    F.col("a.actual").alias("actual"), F.col("a.score").alias("score"))


@query("W3_softened_history", f"""SELECT part_number, s.n AS adjusted, round(list_sum(s.v), 6) AS total, round(s.v[-1], 6) AS last
FROM (SELECT part_number, {Q.soften('h')} AS s FROM b_pser)""")
def w3(spark, path):
    p = part_series(spark, path).select("part_number", FC.soften(F.col("h")).alias("s"))
    return p.select("part_number", F.col("s.n").alias("adjusted"), F.round(FC.asum(F.col("s.v")), 6).alias("total"),
                    F.round(FC.back(F.col("s.v"), 1), 6).alias("last"))


def month_sales(spark, path):
    return FA.clean_sales(I.sales(spark, path), **I.YEARS)


W4 = """
WITH g AS (SELECT part_number, month, model_key, sum(quantity) AS q FROM b_sales GROUP BY ALL), w AS (SELECT month, model_key, sum(wholesale_units) AS u FROM b_wl GROUP BY ALL),
m AS (SELECT part_number, month, sum(q) AS actual, CASE WHEN sum(q) > 0 THEN sum(u * q) / sum(q) ELSE 0 END AS exposure FROM g JOIN w USING (month, model_key) GROUP BY ALL)
SELECT part_number, month, actual, exposure, months, lag(actual, 1) OVER w AS lag1, lag(actual, 2) OVER w AS lag2,
  round(CASE WHEN count(actual) OVER p >= 2 THEN avg(actual) OVER p END, 6) AS rolling3,
  coalesce((exposure - lag(exposure) OVER w) / nullif(lag(exposure) OVER w, 0), 0) AS exposure_change, CAST(row_number() OVER w - 1 AS DOUBLE) AS time_idx
FROM (SELECT *, count(*) OVER (PARTITION BY part_number) AS months FROM m) WHERE months >= 7
WINDOW w AS (PARTITION BY part_number ORDER BY month), p AS (PARTITION BY part_number ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""


@query("W4_J13_exposure_features", W4)
def w4(spark, path):
    return S.exposure_features(month_sales(spark, path), I.wl(spark, path)).withColumn("rolling3", F.round("rolling3", 6))


@query("W5_recent_signals", """SELECT part_number, month, value, sum(value) OVER (PARTITION BY part_number ORDER BY o ROWS 5 PRECEDING) AS recent6,
 sum(value) OVER (PARTITION BY part_number ORDER BY o) AS history FROM b_pdense""")
def w5(spark, path):
    return S.recent_signals(part_long(spark, path), ["part_number"])


@query("W6_month_weights", """SELECT part_number, month, quantity, quantity / sum(quantity) OVER (PARTITION BY month) AS weight
FROM (SELECT part_number, month, sum(quantity) AS quantity FROM b_sales GROUP BY ALL)""")
def w6(spark, path):
    g = month_sales(spark, path).groupBy("part_number", "month").agg(F.sum("quantity").alias("quantity"))
    return S.month_weights(g).select("part_number", "month", "quantity", "weight")


@query("W9_W10_change_windows", """
SELECT part_number, month, value, value - lag(value) OVER w AS delta, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) * 100 AS delta_pct,
 round(avg(value) OVER a, 6) AS recent3, round(avg(value) OVER b, 6) AS prior3, round((avg(value) OVER a - avg(value) OVER b) / nullif(avg(value) OVER b, 0) * 100, 5) AS shift_pct,
 round(value / nullif(avg(value) OVER c, 0) * 100, 5) AS recent6_pct FROM b_pdense
WINDOW w AS (PARTITION BY part_number ORDER BY o), a AS (PARTITION BY part_number ORDER BY o ROWS 2 PRECEDING),
 b AS (PARTITION BY part_number ORDER BY o ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), c AS (PARTITION BY part_number ORDER BY o ROWS 5 PRECEDING)""")
def w9(spark, path):
    c = S.change_windows(part_long(spark, path), ["part_number"])
    return c.withColumns({k: F.round(k, n) for k, n in (("recent3", 6), ("prior3", 6), ("shift_pct", 5), ("recent6_pct", 5))})


@query("W11_cumulative_year", """SELECT month, revenue, round(sum(revenue) OVER (PARTITION BY month[1:4] ORDER BY month), 4) AS cumulative
FROM (SELECT month, CAST(sum(revenue) AS DOUBLE) AS revenue FROM b_sales GROUP BY month)""")
def w11(spark, path):
    m = X.monthly_trend(I.sales(spark, path), "revenue")
    return S.cumulative_by_year(m).withColumn("cumulative", F.round("cumulative", 4))


def _register_model(k, name):
    oracle = f"SELECT part_number, i AS step, round(p[i], 6) AS value FROM (SELECT part_number, {Q.path('h', name, 3)} AS p FROM b_pser), range(1, 4) t(i)"

    @query(f"FC{k}_{name}", oracle)
    def run(spark, path):
        p = part_series(spark, path).select("part_number", F.posexplode(FC.path(F.col("h"), name, 3)).alias("i", "v"))
        return p.select("part_number", (F.col("i") + 1).cast("long").alias("step"), F.round("v", 6).alias("value"))


for _k, _name in ((1, "naive_last"), (2, "mean"), (3, "weighted_moving_average"), (4, "trailing_12_mean"),
                  (5, "trend_adjusted_moving_average"), (6, "damped_trend"), (7, "log_linear_trend"), (8, "seasonal_naive"),
                  (9, "seasonal_mean"), (10, "ets_additive"), (11, "croston_sba")):
    _register_model(_k, _name)

_CAND = "list_filter([" + ", ".join(f"CASE WHEN {Q.eligible('h', s)} THEN '{s[0]}' END" for s in BASELINE_MODELS) + "], lambda z: z IS NOT NULL)"


@query("FC12_candidates", f"SELECT part_number, n, CASE WHEN len(c) > 0 THEN array_to_string(c, ',') ELSE 'mean' END AS candidates FROM (SELECT *, {_CAND} AS c FROM b_pser)")
def fc12(spark, path):
    return part_series(spark, path).select("part_number", "n", F.array_join(FC.candidates(F.col("h")), ",").alias("candidates"))


SELECTED = f"SELECT part_number, start_ord, n, h, {Q.select_best('h')} AS b FROM b_pser"


def selected(spark, path):
    return FC.with_best(part_series(spark, path))


@query("FC13_FC14_model_selection", f"""SELECT part_number, b.model AS model, b.prep AS preprocessing, b.adjusted AS adjusted, round(b.mae, 6) AS mae, round(b.wape, 6) AS wape, round(b.bias, 6) AS bias
FROM ({SELECTED}) WHERE n > 3""")
def fc14(spark, path):
    return selected(spark, path).filter("n > 3").select(
        "part_number", *[F.col(f"b_{c}").alias(c) for c in ("model", "preprocessing", "adjusted")], *[F.round(f"b_{c}", 6).alias(c) for c in ("mae", "wape", "bias")])


_CONF = """CASE WHEN b.wape IS NULL THEN 'Low' WHEN n >= 18 AND b.wape <= 0.25 AND vol <= 0.8 AND bb <= 0.2 THEN 'High'
 WHEN n >= 12 AND b.wape <= 0.45 AND vol <= 1.25 AND bb <= 0.45 THEN 'Medium' ELSE 'Low' END"""
PROFILE = f"""SELECT *, {_CONF} AS confidence FROM (SELECT *, coalesce(abs(b.bias), 1) AS bb,
  CASE WHEN lvl > 0 THEN list_stddev_pop(h) / lvl ELSE 1.5 END AS vol, CASE WHEN am > 0 THEN list_stddev_pop(h) / am END AS rvol FROM (
  SELECT *, coalesce(list_avg(list_filter(h, lambda x: x <> 0)), list_avg(h), 0) AS lvl, list_avg(h) AS am FROM ({SELECTED}) WHERE n > 3))"""


@query("FC15_FC16_confidence_band", f"""
SELECT part_number, confidence, i AS step, round(v, 6) AS forecast, round(greatest(0, v - s), 6) AS lower, round(v + s, 6) AS upper FROM (
 SELECT *, greatest(b.mae, v * 0.12) * sqrt(i) * 1.28 AS s FROM (SELECT *, p[i] AS v FROM (
  SELECT *, {Q.path_by_name('tr', 'b.model', 3)} AS p FROM (SELECT *, b.train AS tr FROM ({PROFILE}))), range(1, 4) t(i)))""")
def fc16(spark, path):
    s = FC.with_path(selected(spark, path).filter("n > 3"), "b_train", "b_model", 3, "p")
    return s.select("part_number", FC.confidence(F.col("h"), F.col("b_wape"), F.col("b_bias")).alias("confidence"),
                    F.posexplode(FC.band(F.col("h"), F.col("p"), F.col("b_mae"))).alias("i", "x")).select(
        "part_number", "confidence", (F.col("i") + 1).cast("long").alias("step"),
        *[F.round(f"x.{c}", 6).alias(c) for c in ("forecast", "lower", "upper")])


REGIME = """CASE WHEN n < 4 THEN 'sparse_history' WHEN pri > 0 AND rec <= pri * 0.45 AND h[-1] <= pri * 0.25 AND h[-2] <= pri * 0.45 THEN 'structural_drop'
 WHEN pri > 0 AND rec >= pri * 1.8 AND h[-1] >= greatest(pri * 1.6, list_median(h) * 1.5) THEN 'structural_ramp'
 WHEN pri > 0 AND rec <= pri * 0.7 THEN 'declining' WHEN pri > 0 AND rec >= pri * 1.35 THEN 'accelerating' WHEN rvol >= 0.95 THEN 'volatile' ELSE 'stable' END"""
_RP = "coalesce(list_avg(CASE WHEN n >= 6 THEN h[-6:-4] ELSE h[:n - 3] END), 0) AS pri, list_sum(h[-3:]) / len(h[-3:]) AS rec"


@query("FC17_regime", f"""SELECT part_number, {REGIME} AS code, CASE WHEN n >= 4 THEN (h[-1] - h[-2]) / nullif(h[-2], 0) * 100 END AS change_pct,
 CASE WHEN n >= 4 AND pri > 0 THEN round((rec - pri) / pri * 100, 5) END AS shift_pct, CASE WHEN n >= 4 THEN round(rvol, 6) END AS volatility
FROM (SELECT *, {_RP}, CASE WHEN list_avg(h) > 0 THEN list_stddev_pop(h) / list_avg(h) END AS rvol FROM b_pser)""")
def fc17(spark, path):
    r = FC.once(part_series(spark, path), "r", FC.regime(F.col("h")), ("code", "label", "severity", "change_pct", "shift_pct", "volatility"))
    return r.select("part_number", F.col("r_code").alias("code"), F.col("r_change_pct").alias("change_pct"), F.round("r_shift_pct", 5).alias("shift_pct"), F.round("r_volatility", 6).alias("volatility"))


def rated(spark, path):
    """Every series with its selection, shape, risk, tier and score: one narrow projection."""
    return FO.rate(part_series(spark, path))


RATED = f"""
WITH a AS (SELECT part_number, count(*) AS na FROM (SELECT *, coalesce(resid / nullif(CASE WHEN count(resid) OVER w >= 3 THEN median(resid) OVER w END, 0), 0) AS score FROM (
  SELECT *, abs(value - CASE WHEN count(value) OVER v >= 3 THEN median(value) OVER v END) AS resid FROM b_pdense WINDOW v AS (PARTITION BY part_number ORDER BY o ROWS 5 PRECEDING))
  WINDOW w AS (PARTITION BY part_number ORDER BY o ROWS 5 PRECEDING)) WHERE score >= 2 GROUP BY ALL),
r AS (SELECT part_number, n, confidence, b, {REGIME} AS code, rvol, CASE WHEN n >= 5 THEN coalesce(na, 0) ELSE 0 END AS na FROM (SELECT *, {_RP} FROM ({PROFILE})) LEFT JOIN a USING (part_number)),
k AS (SELECT *, CASE WHEN confidence = 'Low' OR coalesce(b.wape >= 0.55, false) OR code IN ('structural_drop', 'structural_ramp') THEN 'High'
  WHEN na = 0 AND code = 'stable' AND b.wape <= 0.22 AND coalesce(abs(b.bias) <= 0.2, true) THEN 'Low'
  WHEN na > 0 OR code IN ('declining', 'accelerating', 'volatile') OR coalesce(b.wape > 0.22, false) OR coalesce(abs(b.bias) > 0.2, false) THEN 'Medium' ELSE 'Low' END AS risk FROM r),
rated AS (SELECT *, CASE WHEN n < 6 OR risk = 'High' OR code IN ('structural_drop', 'structural_ramp', 'sparse_history') OR b.wape IS NULL OR b.wape > 0.45 THEN 'do_not_auto_plan'
  WHEN n >= 12 AND b.wape <= 0.22 AND coalesce(abs(b.bias) <= 0.18, true) AND code = 'stable' AND risk = 'Low' AND coalesce(rvol <= 0.85, true) THEN 'planner_ready' ELSE 'needs_review' END AS tier,
  round(greatest(0, least(100, least(n / 18.0::DOUBLE, 1) * 22 + CASE WHEN b.wape IS NULL THEN 0 ELSE greatest(0, 1 - least(b.wape, 1)) * 38 END + greatest(0, 1 - least(coalesce(abs(b.bias), 1), 1)) * 14
  + CASE confidence WHEN 'High' THEN 14 WHEN 'Medium' THEN 8 ELSE 2 END - CASE code WHEN 'stable' THEN 0 WHEN 'declining' THEN 4 WHEN 'accelerating' THEN 4 WHEN 'volatile' THEN 7 WHEN 'structural_drop' THEN 18 WHEN 'structural_ramp' THEN 16 ELSE 15 END
  - CASE risk WHEN 'Low' THEN 0 WHEN 'Medium' THEN 7 ELSE 18 END)), 1) AS score FROM k)
"""


@query("FC18_FC19_risk_and_tier", RATED + "SELECT part_number, code, risk, tier, score, confidence, na > 0 AS has_anomaly FROM rated")
def fc19(spark, path):
    return rated(spark, path).select("part_number", F.col("r_code").alias("code"), "risk", "tier", "score", "confidence", (F.size("anomalies") > 0).alias("has_anomaly"))


def day_ratios(spark, path, df, horizon, origin=None):
    """Array of working-day ratios target / target-12 for the months after each series end."""
    cal = I.cal(spark, path).select(F.map_from_entries(F.collect_list(F.struct(D.month_ord(F.col("month")), "working_days"))).alias("days"))
    end = F.col("start_ord") + (F.col("n") if origin is None else origin) - 1
    r = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.coalesce(
        F.try_divide(F.try_element_at("days", end + k), F.try_element_at("days", end + k - 12)), F.lit(1.0)))
    return df.crossJoin(F.broadcast(cal)).withColumn("ratios", r).drop("days")     # one row: the calendar


@query("FC24_working_day_seasonal", """
WITH d AS (SELECT CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, working_days AS w FROM b_cal)
SELECT part_number, k AS step, round(greatest(0, CASE WHEN n >= 12 THEN h[-12 + (k - 1)::INT] ELSE NULL END * coalesce(a.w / b.w, 1)), 6) AS value
FROM (SELECT * FROM b_pser, range(1, 4) t(k) WHERE n >= 12) LEFT JOIN d a ON a.o = start_ord + n - 1 + k LEFT JOIN d b ON b.o = start_ord + n - 13 + k""")
def fc24(spark, path):
    s = day_ratios(spark, path, part_series(spark, path).filter("n >= 12"), 3)
    return s.select("part_number", F.posexplode(FC.working_day_seasonal(F.col("h"), F.col("ratios"))).alias("i", "v")).select(
        "part_number", (F.col("i") + 1).cast("long").alias("step"), F.round("v", 6).alias("value"))
