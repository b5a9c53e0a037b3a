"""Queries: folds, metrics, audits, intervals, champions, nowcasts (E*, R8, FC26-FC31, U1)."""

from pyspark.sql import functions as F

from ..config import BacktestContract
from ..functions import dates as D
from ..functions import forecast as FC
from ..operators import evaluate as EV
from ..operators import series as S
from ..session import materialize
from . import inputs as I
from . import series_sql as Q
from .registry import query
from .series import SELECTED, part_series, selected

CUTOFF = "2001-10"
ENTITIES = ["GMA", "HMA", "KUS"]
METRICS = ["wape", "accuracy", "mae", "signed_bias", "bias_pct", "fold_std", "coverage", "actual_total", "prediction_total"]
METHOD = {"HMA": "ets_additive", "GMA": "naive_last", "KUS": "seasonal_mean"}
METHOD_SQL = "CASE entity WHEN 'HMA' THEN 'ets_additive' WHEN 'GMA' THEN 'naive_last' ELSE 'seasonal_mean' END"


def rounded(df, cols=METRICS, n=5):
    return df.withColumns({c: F.round(c, n) for c in cols if c in df.columns})


def anchor_series(spark, path, value="quantity"):
    """A series for each anchor, read from storage: folds, totals and checks read it several times, the sales once."""
    f = I.anchored_sales(spark, path).withColumnRenamed("anchor_brand", "entity")
    return materialize(S.pack(f, ["entity"], F.col(value).cast("double"), end=CUTOFF))


def method_column():
    return F.when(F.col("entity") == "HMA", METHOD["HMA"]).when(F.col("entity") == "GMA", METHOD["GMA"]).otherwise(METHOD["KUS"])


def portfolio_rows(spark, path):
    return EV.folds(anchor_series(spark, path), ["entity"], method_column())


def folds_sql(src, key, name, h="h", top=3, least=24):
    """Fold rows: key, origin_month, target_month, horizon, actual, prediction, training_months."""
    m = lambda o: f"printf('%04d-%02d', ({o}) // 12, ({o}) % 12 + 1)"
    p = Q.path_by_name("t", name, top) if name.startswith(("CASE", "model")) else Q.path("t", name, top)
    return f"""SELECT {key}, {m('start_ord + o - 1')} AS origin_month, {m('start_ord + o - 1 + k')} AS target_month, CAST(k AS INT) AS horizon, h[o + k] AS actual,
 greatest(p[k], 0) AS prediction, CAST(o AS INT) AS training_months FROM (SELECT *, {p} AS p FROM (SELECT *, h[:o] AS t FROM (
 SELECT {key}, start_ord, {h} AS h, n, unnest(range({least}, n)) AS o, {name if name.startswith('CASE') else "'x'"} AS model FROM {src}))), range(1, {top + 1}) r(k) WHERE o + k <= n"""


PORT = folds_sql("b_aser", "entity", METHOD_SQL).replace(Q.path_by_name("t", METHOD_SQL, 3), Q.path_by_name("t", "model", 3))


def metrics_sql(group=""):
    return f"""{group} round(sum(abs(prediction - actual)) / nullif(sum(abs(actual)) FILTER (prediction IS NOT NULL), 0), 5) AS wape,
 round(greatest(0, 1 - sum(abs(prediction - actual)) / nullif(sum(abs(actual)) FILTER (prediction IS NOT NULL), 0)), 5) AS accuracy,
 round(avg(abs(prediction - actual)), 5) AS mae, round(avg(prediction - actual), 5) AS signed_bias,
 round(sum(prediction - actual) / nullif(sum(abs(actual)) FILTER (prediction IS NOT NULL), 0), 5) AS bias_pct,
 round(stddev_pop(abs(prediction - actual) / nullif(abs(actual), 0)), 5) AS fold_std, round(count(prediction) / count(*)::DOUBLE, 5) AS coverage,
 count(prediction) AS fold_count, count(*) AS row_count, round(coalesce(sum(actual) FILTER (prediction IS NOT NULL), 0), 5) AS actual_total, round(coalesce(sum(prediction), 0), 5) AS prediction_total"""


def _fold_out(df, keys):
    return df.select(*keys, "origin_month", "target_month", "horizon", "actual", F.round("prediction", 5).alias("prediction"), "training_months")


@query("E3_rolling_folds", f"SELECT * REPLACE (round(prediction, 5) AS prediction) FROM ({folds_sql('b_pser', 'part_number', 'damped_trend')})")
def e3(spark, path):
    return _fold_out(EV.folds(part_series(spark, path), ["part_number"], "damped_trend"), ["part_number"])


@query("E3_U1_custom_predictor", f"""SELECT * REPLACE (CASE WHEN horizon = 2 THEN NULL ELSE prediction END AS prediction), CASE WHEN horizon = 2 THEN 'ValueError: no second step' END AS error
FROM ({folds_sql('b_aser', 'entity', 'naive_last')})""")
def u1(spark, path):
    def predictor(history, horizon):
        if horizon == 2:
            raise ValueError("no second step")
        return history[-1], "last"
    d = EV.folds_with(anchor_series(spark, path), ["entity"], predictor)
    return d.drop("backtest_model")


@query("E4_R8_portfolio_total", f"""WITH f AS ({PORT}), c AS (SELECT origin_month, target_month, horizon FROM f GROUP BY ALL HAVING count(DISTINCT entity) = 3)
SELECT origin_month, target_month, horizon, sum(actual) AS actual, round(CASE WHEN count(prediction) = 3 THEN sum(prediction) END, 5) AS prediction
FROM f SEMI JOIN c USING (origin_month, target_month, horizon) GROUP BY ALL""")
def e4(spark, path):
    return EV.portfolio_total(portfolio_rows(spark, path), 3).withColumn("prediction", F.round("prediction", 5))


@query("E1_FC27_portfolio_metrics", f"""WITH f AS ({PORT}) SELECT {metrics_sql("coalesce(entity, 'all') AS entity, coalesce(horizon, 0) AS horizon,")}
FROM f GROUP BY GROUPING SETS ((entity), (horizon), (entity, horizon), ())""")
def e1(spark, path):
    m = EV.summarize(portfolio_rows(spark, path), ["entity", "horizon"], [["entity"], ["horizon"], ["entity", "horizon"], []])
    return rounded(m).withColumns({"entity": F.coalesce("entity", F.lit("all")), "horizon": F.coalesce("horizon", F.lit(0))})


@query("E13_evaluation_scopes", f"""WITH f AS ({PORT}) SELECT 'entity_rows' AS scope, {metrics_sql()} FROM f
UNION ALL SELECT 'common_origin_total', {metrics_sql()} FROM (SELECT sum(actual) AS actual, sum(prediction) AS prediction FROM f GROUP BY origin_month, target_month, horizon HAVING count(DISTINCT entity) = 3)""")
def e13(spark, path):
    return rounded(EV.evaluation_scopes(portfolio_rows(spark, path), ENTITIES))


@query("E5_fold_audit", f"""WITH f AS ({PORT}), k AS (SELECT horizon, origin_month, count(DISTINCT entity) AS ents FROM f GROUP BY ALL)
SELECT 0 AS duplicate_rows, (SELECT count(*) FROM f WHERE prediction IS NULL) AS missing_predictions, (SELECT count(*) FROM k WHERE ents <> 3) AS entity_mismatches,
 (SELECT count(*) FROM k WHERE horizon = 1) AS h1, (SELECT count(*) FROM k WHERE horizon = 2) AS h2, (SELECT count(*) FROM k WHERE horizon = 3) AS h3, (SELECT count(*) FROM k) AS combined,
 (SELECT count(*) FROM k WHERE horizon = 1) <> 58 AS count_mismatch, 1.0::DOUBLE AS coverage,
 CASE WHEN (SELECT count(*) FROM k WHERE horizon = 1) = 58 AND (SELECT count(*) FROM k WHERE ents <> 3) = 0 THEN 'pass' ELSE 'fail' END AS status""")
def e5(spark, path):
    return EV.audit(portfolio_rows(spark, path), BacktestContract().expected_counts(82), ENTITIES)


@query("E6_intervals", f"""WITH f AS ({PORT}), p AS (SELECT entity, k AS horizon, printf('%04d-%02d', (2001 * 12 + 9 + k) // 12, (2001 * 12 + 9 + k) % 12 + 1) AS month, h[-1] AS point FROM b_aser, range(1, 4) t(k)),
r AS (SELECT entity, horizon, target_month, origin_month, abs(actual - prediction) AS r, list(abs(actual - prediction)) OVER (PARTITION BY entity, horizon ORDER BY target_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM f),
j AS (SELECT p.entity, p.horizon, p.month, p.point, list_sort(list(r.r)) AS rs, count(*) AS n,
  sum(CASE WHEN len(prior) >= 5 THEN CASE WHEN r.r <= list_sort(prior)[ceil(0.9::DOUBLE * (len(prior) - 1))::INT + 1] THEN 1 ELSE 0 END END) AS hits
  FROM p JOIN r ON p.entity = r.entity AND p.horizon = r.horizon AND r.target_month < p.month GROUP BY ALL)
SELECT entity, CAST(horizon AS INT) AS horizon, month, point, round(greatest(0, point - rs[ceil(0.9::DOUBLE * (n - 1))::INT + 1]), 5) AS lower, round(point + rs[ceil(0.9::DOUBLE * (n - 1))::INT + 1], 5) AS upper,
 round(hits / greatest(n - 5, 0), 6) AS empirical_coverage, CAST(n - 5 AS INT) AS coverage_samples, CAST(n AS INT) AS residual_count, 'validated' AS status FROM j""")
def e6(spark, path):
    a = anchor_series(spark, path)
    pts = a.select("entity", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("horizon"), "start_ord", "n", F.element_at("h", -1).alias("point"))
    pts = pts.select("entity", "horizon", D.month_from_ord(F.col("start_ord") + F.col("n") - 1 + F.col("horizon")).alias("month"), "point")
    iv = EV.intervals(pts, portfolio_rows(spark, path), ["entity"])
    return iv.withColumns({"lower": F.round("lower", 5), "upper": F.round("upper", 5), "empirical_coverage": F.round("empirical_coverage", 6)})


MODELS3 = ("naive_last", "seasonal_mean", "trailing_12_mean", "weighted_moving_average")


def model_metrics(spark, path):
    """Metrics of several methods over the same folds of every anchor."""
    a = anchor_series(spark, path)
    a = a.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS3])))
    rows = EV.folds(a, ["entity", "model"], F.col("model"))
    tot = rows.groupBy("model", *EV.FOLD).agg(F.sum("actual").alias("actual"), F.sum("prediction").alias("prediction"))
    return EV.summarize(tot, ["model"])


_MM = "WITH t AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, origin_month, target_month, horizon, sum(actual) AS actual, sum(prediction) AS prediction FROM ({folds_sql('b_aser', 'entity', m)}) GROUP BY ALL"
    for m in MODELS3) + f"), m AS (SELECT {metrics_sql('model,')} FROM t GROUP BY model)"


@query("E10_leaderboard", _MM + " SELECT *, row_number() OVER (ORDER BY wape, abs(bias_pct), model) AS rank FROM m")
def e10(spark, path):
    return rounded(EV.leaderboard(model_metrics(spark, path)))


@query("E9_champion", _MM + """, k AS (SELECT * FROM m WHERE wape <= (SELECT min(wape) FROM m) + 0.005)
SELECT (SELECT model FROM k ORDER BY abs(bias_pct), fold_std, -coverage, model LIMIT 1) AS champion, (SELECT count(*) FROM k) AS tie_count,
 (SELECT string_agg(model, ',' ORDER BY model) FROM k) AS tie_set, (SELECT min(wape) FROM m) AS minimum_wape""")
def e9(spark, path):
    return EV.champion(model_metrics(spark, path)).withColumn("minimum_wape", F.round("minimum_wape", 5))


OUTER = f"""SELECT part_number, b.model AS backtest_model, n, split, h[split + 1:] AS act, p FROM (SELECT *, list_transform(range(split, n), lambda i: """ + Q.let(
    "t[:i]", "z", "greatest(0.0::DOUBLE, " + Q.path_by_name("z", "m", 1) + "[1])") + f""") AS p FROM (
 SELECT *, b.model AS m, CASE WHEN b.prep = 'cleaned' THEN ({Q.soften('h')}).v ELSE h END AS t FROM (SELECT *, {Q.select_best('hh')} AS b FROM (
  SELECT *, h[:split] AS hh FROM (SELECT *, n - least(6, greatest(3, n // 4)) AS split FROM b_pser) WHERE split >= 3))))"""


@query("E2_outer_test", f"""SELECT part_number, backtest_model, CAST(len(act) AS INT) AS points, list_sum(act) AS actual_sum,
 round(list_sum(list_transform(p, lambda x, i: abs(x - act[i]))), 5) AS abs_error, round(CASE WHEN list_sum(act) > 0 THEN list_sum(list_transform(p, lambda x, i: abs(x - act[i]))) / list_sum(act) END, 5) AS wape FROM ({OUTER})""")
def e2(spark, path):
    return EV.outer_test(part_series(spark, path), ["part_number"]).select(
        "part_number", "backtest_model", "points", "actual_sum", F.round("abs_error", 5).alias("abs_error"), F.round("wape", 5).alias("wape"))


@query("E15_auto_residuals", f"""SELECT entity, origin_month, target_month, horizon, actual, round(prediction, 5) AS prediction, label AS backtest_model FROM (
 SELECT entity, printf('%04d-%02d', (start_ord + o - 1) // 12, (start_ord + o - 1) % 12 + 1) AS origin_month,
  printf('%04d-%02d', (start_ord + o - 1 + k) // 12, (start_ord + o - 1 + k) % 12 + 1) AS target_month, CAST(k AS INT) AS horizon, h[o + k] AS actual,
  greatest(p[k], 0) AS prediction, b.model || ':' || b.prep AS label
 FROM (SELECT *, {Q.path_by_name('tr', 'm', 3)} AS p FROM (SELECT *, b.train AS tr, b.model AS m FROM (SELECT *, {Q.select_best('t')} AS b FROM (
  SELECT *, h[:o] AS t FROM (SELECT entity, start_ord, h, n, unnest(range(24, n)) AS o FROM b_aser))))), range(1, 4) r(k) WHERE o + k <= n)""")
def e15(spark, path):
    r = EV.folds(anchor_series(spark, path), ["entity"], "auto")
    return r.select("entity", "origin_month", "target_month", "horizon", "actual", F.round("prediction", 5).alias("prediction"), "backtest_model")


def nowcast_rows(spark, path):
    """Every (month, cutoff day): month-to-date projection by weekday share, and last month's total."""
    s = I.sales(spark, path).groupBy("sale_date").agg(F.sum("quantity").alias("q"))
    days = s.select("sale_date", "q", F.explode(F.array(*[F.lit(d) for d in (5, 10, 15, 20, 25)])).alias("cutoff_day"))
    m = days.groupBy(D.month_of("sale_date").alias("month"), "cutoff_day").agg(
        F.sum("q").alias("actual"), F.sum(F.when(F.dayofmonth("sale_date") <= F.col("cutoff_day"), F.col("q")).otherwise(0.0)).alias("mtd"))
    done = D.month_completion(F.date_add(D.month_start(F.col("month")), F.col("cutoff_day") - 1))
    prev = m.select(D.month_of(F.add_months(D.month_start(F.col("month")), 1)).alias("month"), "cutoff_day", F.col("actual").alias("premonth"))
    return m.join(prev, ["month", "cutoff_day"]).withColumn("mtd_projection", F.col("mtd") / F.nullif(done, F.lit(0.0)))


@query("FC31_F13_nowcast_backtest", f"""WITH d AS (SELECT sale_date, month, sum(quantity) AS q FROM b_sales GROUP BY ALL), c AS (SELECT * FROM (VALUES (5, 0.1::DOUBLE), (10, 0.3::DOUBLE), (15, 0.5::DOUBLE), (20, 0.7::DOUBLE), (25, 0.9::DOUBLE)) t(cutoff_day, weight)),
m AS (SELECT month, cutoff_day, weight, sum(q) AS actual, sum(CASE WHEN day(sale_date) <= cutoff_day THEN q ELSE 0 END) AS mtd FROM d, c GROUP BY ALL),
x AS (SELECT *, lag(actual) OVER (PARTITION BY cutoff_day ORDER BY month) AS premonth,
  (SELECT count(*) FROM range(1, 32) t(i) WHERE i <= cutoff_day AND isodow(CAST(month || '-01' AS DATE) + (i - 1)::INT) <= 5) / (SELECT working_days FROM b_cal WHERE b_cal.month = m.month) AS done FROM m),
p AS (SELECT cutoff_day, actual, (1 - weight) * premonth + weight * (mtd / done) AS prediction FROM x WHERE premonth IS NOT NULL)
SELECT {metrics_sql("coalesce(cutoff_day, 0) AS cutoff_day,")} FROM p GROUP BY GROUPING SETS ((cutoff_day), ())""")
def fc31(spark, path):
    weights = spark.createDataFrame([(5, 0.1), (10, 0.3), (15, 0.5), (20, 0.7), (25, 0.9)], "cutoff_day int, weight double")
    r = EV.nowcast_backtest(nowcast_rows(spark, path), weights)
    return rounded(r).withColumn("cutoff_day", F.coalesce("cutoff_day", F.lit(0)))
