"""Queries: sinks, run identity, evidence, learned challengers, smoothing grid (S7-S11, E11-E17, M*, FC32, H8, H11, A21, A30, A32, P7)."""

import uuid
from functools import cached_property

from pyspark.sql import functions as F

from ..config import BacktestContract
from ..functions import forecast as FC
from ..functions import text as T
from ..operators import center as CC
from ..operators import challengers as CH
from ..operators import evaluate as EV
from ..operators import explore as X
from ..operators import facts as FA
from ..operators import forecasting as FO
from ..operators import hierarchy as HI
from ..operators import ml as ML
from ..operators import series as S
from ..operators import smoothing as SM
from ..session import checkpoint_dir, materialize
from ..sources import planning as P
from ..sources import sheets as SH
from ..sources import sinks as SK
from . import inputs as I
from . import series_sql as Q
from .base_sql import block
from .evaluate import ENTITIES, PORT, anchor_series, folds_sql, metrics_sql, method_column, portfolio_rows, rounded
from .hierarchy import CO, CUTOFF, MODEL, PLC, Center, alloc_blocks, brand_forecast, part_plan
from .registry import query


def folder(spark) -> str:
    """A new folder for this call inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"


@query("S7_prepared_source", "SELECT month, count(*) AS n, sum(quantity) AS quantity FROM b_factsraw GROUP BY month")
def s7(spark, path):
    base = folder(spark)
    build = lambda: I.facts(spark, path, model_year=True)
    SK.prepared(spark, base, "demo", "facts", build, ["month"])
    again = SK.prepared(spark, base, "demo", "facts", build, ["month"])          # read back, not built again
    return again.groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("S8_filtered_export", "SELECT brand, model_name, quantity FROM b_sales WHERE brand = 'H' AND quantity > 45")
def s8(spark, path):
    out = folder(spark)
    SK.export_csv(X.apply_filters(I.sales(spark, path), X.Filters(brand=("H",))).filter("quantity > 45"), out, ["brand", "model_name", "quantity"])
    return spark.read.csv(out, header=True, schema="brand string, model_name string, quantity double")


def series_block(rows: str) -> str:
    """Dense monthly series per entity, to the cutoff, of rows (entity, month, v)."""
    m = f"SELECT entity, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, sum(greatest(coalesce(v, 0), 0)) AS v FROM ({rows}) WHERE month <= '{CUTOFF}' GROUP BY ALL"
    return f"""SELECT e.entity, CAST(min(e.o) AS INT) AS start_ord, list(coalesce(m.v, 0) ORDER BY e.o) AS h, CAST(count(*) AS INT) AS n
FROM (SELECT entity, unnest(range(min(o), 2001 * 12 + 10)) AS o FROM ({m}) GROUP BY entity) e LEFT JOIN ({m}) m ON e.entity = m.entity AND e.o = m.o GROUP BY e.entity"""


_PATH = lambda src: f"SELECT entity AS brand, printf('%04d-%02d', (2001 * 12 + 9 + k) // 12, (2001 * 12 + 9 + k) % 12 + 1) AS month, {Q.path('h', 'trailing_12_mean', 3)}[k] AS value FROM {src}, range(1, 4) t(k)"
block("b_aserr", series_block("SELECT anchor_brand AS entity, month, CAST(revenue AS DOUBLE) AS v FROM b_factsraw"))
block("b_aserw", series_block("SELECT anchor_brand AS entity, month, wholesale_units + fleet_units AS v FROM b_wl"))
block("b_export", f"""SELECT 'quantity' AS metric, 'brand' AS level, brand, '' AS entity_key, '' AS model_name, '' AS plc, month, 'Forecast' AS forecast_type, '' AS route, value, NULL::DOUBLE AS share FROM b_brandfc
UNION ALL SELECT 'quantity', 'model', brand, entity_key, model_name, '', month, 'Forecast', route, value, share FROM b_ma
UNION ALL SELECT 'quantity', 'plc', brand, entity_key, model_name, plc, month, 'Forecast', route, value, share FROM b_pa
UNION ALL SELECT 'revenue', 'brand', brand, '', '', '', month, 'Forecast', '', value, NULL FROM ({_PATH('b_aserr')})
UNION ALL SELECT 'wholesale_quantity', 'brand', brand, '', '', '', month, 'Forecast', '', value, NULL FROM ({_PATH('b_aserw')})""")


def output_run(spark, path, base):
    """One immutable run: a payload for each of three metrics and the part plan, committed together. The second call reads the first's."""
    rid = SK.run_id(path.rstrip("/").rsplit("/", 1)[-1], {"brand": ["HMA", "HMA ", ""]}, {"horizon": 3})

    def build():
        c = Center(spark, path)
        volumes = I.wl(spark, path).select(F.col("anchor_brand").alias("brand"), "month", (F.col("wholesale_units") + F.col("fleet_units")).alias("quantity"))
        money = c.facts.select("brand", "month", F.col("revenue").cast("double").alias("quantity"))
        return {"forecast_quantity": SK.export_rows("quantity", {"brand": c.brand, "model": c.model, "plc": c.plc}),
                "forecast_revenue": SK.export_rows("revenue", {"brand": brand_forecast(money)}),
                "forecast_wholesale_quantity": SK.export_rows("wholesale_quantity", {"brand": brand_forecast(volumes)}), "part_plan": part_plan(c)}
    SK.get_or_create_run(spark, base, rid, build, about={"horizon": 3})
    return rid, SK.get_or_create_run(spark, base, rid, build)


@query("S9_forecast_export", "SELECT * REPLACE (round(value, 4) AS value, round(share, 6) AS share) FROM b_export")
def s9(spark, path):
    base, out = folder(spark), folder(spark)
    _, t = output_run(spark, path, base)
    rows = t["forecast_quantity"].unionByName(t["forecast_revenue"]).unionByName(t["forecast_wholesale_quantity"])
    SK.export_csv(rows, out, list(SK.EXPORT))
    back = spark.read.csv(out, header=True, schema=", ".join(f"{c} {'double' if c in ('value', 'share') else 'string'}" for c in SK.EXPORT), emptyValue="")
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SK.EXPORT if c not in ("value", "share")]
    return back.select(*text, F.round("value", 4).alias("value"), F.round("share", 6).alias("share"))


@query("S10_E14_output_run", """SELECT 'forecast_quantity' AS "table", count(*) AS rows, true AS intact FROM b_export WHERE metric = 'quantity' UNION ALL SELECT 'forecast_revenue', count(*), true FROM b_export WHERE metric = 'revenue'
UNION ALL SELECT 'forecast_wholesale_quantity', count(*), true FROM b_export WHERE metric = 'wholesale_quantity' UNION ALL SELECT 'part_plan', count(*), true FROM b_pq""")
def s10(spark, path):
    base = folder(spark)
    rid, tables = output_run(spark, path, base)
    said, seen = SK.manifest_rows(spark, base, rid), None
    for name, df in tables.items():
        one = SK.fingerprint(df).select(F.lit(name).alias("table"), F.col("fingerprint").alias("now"))
        seen = one if seen is None else seen.unionByName(one)
    return said.join(seen, "table").select("table", "rows", (F.col("fingerprint") == F.col("now")).alias("intact"))


@query("S11_F23_fingerprint")
def s11(spark, path):
    s = I.sales(spark, path)
    a = SK.fingerprint(s).withColumn("variant", F.lit("as_is"))
    b = SK.fingerprint(s.select(*reversed(s.columns)).orderBy("quantity")).withColumn("variant", F.lit("reordered"))
    return a.unionByName(b)


@query("A21_P7_pivot_catalog", """SELECT count(DISTINCT channel) AS channels, 'brand,model,model_year,part,month,year' AS dimensions, 'quantity,revenue,records' AS measures, true AS wide FROM b_whrows""")
def a21(spark, path):
    cat = X.pivot_catalog(I.sales(spark, path).columns)
    ch = P.wholesale_rows(spark, path).agg(F.count_distinct("channel").alias("channels"))
    return ch.select("channels", F.lit(",".join(cat["dimensions"])).alias("dimensions"), F.lit(",".join(cat["measures"])).alias("measures"),
                     F.lit(SH.is_wide_matrix(["Brand", "Model", "Jan", "Feb (2)"], {})).alias("wide"))


@query("A32_workspace")
def a32(spark, path):
    s = X.apply_filters(I.sales(spark, path, model_year=True), X.Filters(brand=("H",), model_year=("1999",)))
    kpi = X.kpis(s).select(F.lit("kpi").alias("part"), F.lit("row_count").alias("name"), F.col("row_count").cast("double").alias("value"))
    top = X.top_groups(s, F.col("model_name"), "revenue", 10).select(F.lit("top_models").alias("part"), "name", "value")
    fac = X.facet_options(I.sales(spark, path, model_year=True), X.Filters(brand=("H",), model_year=("1999",))).select(
        F.concat(F.lit("facet_"), "facet").alias("part"), F.col("value").alias("name"), F.col("n").cast("double").alias("value"))
    return kpi.unionByName(top).unionByName(fac)


def evidence(spark, path):
    rows = portfolio_rows(spark, path)
    a = EV.audit(rows, BacktestContract().expected_counts(82), ENTITIES)
    span = rows.agg(F.max("target_month").alias("last_target"), F.count_distinct("entity").alias("entities"),
                    F.count_if(F.col("target_month") <= F.col("origin_month")).alias("leaks"))
    return a.crossJoin(span)                   # two one-row tables


@query("E11_evidence_gate", f"""WITH f AS ({PORT}), c AS (SELECT max(target_month) = '{CUTOFF}' AS cutoff, count(DISTINCT entity) = 3 AS entities, count(DISTINCT origin_month) FILTER (horizon = 1) = 58
 AND count(DISTINCT origin_month) FILTER (horizon = 2) = 57 AND count(DISTINCT origin_month) FILTER (horizon = 3) = 56 AS fold_counts, count(prediction) = count(*) AS coverage,
 count(*) FILTER (target_month <= origin_month) = 0 AS no_leak FROM f)
SELECT "check", passed FROM (UNPIVOT (SELECT *, cutoff AND entities AND fold_counts AND coverage AND no_leak AS "all" FROM c) ON cutoff, entities, fold_counts, coverage, no_leak, "all" INTO NAME "check" VALUE passed)""")
def e11(spark, path):
    return EV.check_rows(evidence(spark, path), cutoff=F.col("last_target") == CUTOFF, entities=F.col("entities") == 3, fold_counts=~F.col("count_mismatch"),
                         coverage=F.col("coverage") == 1.0, no_leak=F.col("leaks") == 0)


@query("E12_promotion_gate", f"""WITH a AS (SELECT {metrics_sql()} FROM (SELECT sum(actual) AS actual, sum(prediction) AS prediction FROM ({PORT}) GROUP BY origin_month, target_month, horizon)),
b AS (SELECT {metrics_sql()} FROM (SELECT sum(actual) AS actual, sum(prediction) AS prediction FROM ({folds_sql('b_aser', 'entity', 'naive_last')}) GROUP BY origin_month, target_month, horizon)),
c AS (SELECT a.wape < b.wape AS lower_wape, abs(a.bias_pct) <= 0.1 AS small_bias, a.coverage = 1 AS full_coverage, a.fold_count = b.fold_count AS same_folds FROM a, b)
SELECT "check", passed FROM (UNPIVOT (SELECT *, lower_wape AND small_bias AND full_coverage AND same_folds AS "all" FROM c) ON lower_wape, small_bias, full_coverage, same_folds, "all" INTO NAME "check" VALUE passed)""")
def e12(spark, path):
    tot = lambda rows, tag: EV.summarize(EV.portfolio_total(rows, 3)).select(*[F.col(c).alias(f"{tag}_{c}") for c in ("wape", "bias_pct", "coverage", "fold_count")])
    series = anchor_series(spark, path)
    j = tot(EV.folds(series, ["entity"], method_column()), "a").crossJoin(tot(EV.folds(series, ["entity"], "naive_last"), "b"))       # one row each
    return EV.check_rows(j, lower_wape=F.col("a_wape") < F.col("b_wape"), small_bias=F.abs("a_bias_pct") <= 0.1, full_coverage=F.col("a_coverage") == 1, same_folds=F.col("a_fold_count") == F.col("b_fold_count"))


@query("E16_governance_row")
def e16(spark, path):
    m = anchor_series(spark, path).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "entity", method_column()))), ",").alias("methods"))
    f = SK.fingerprint(I.sales(spark, path)).select("fingerprint")
    e = evidence(spark, path).select("combined", "status", "last_target")
    return e.crossJoin(m).crossJoin(f).select(F.lit("fixed_portfolio").alias("strategy"), "fingerprint", F.col("last_target").alias("cutoff"), F.col("combined").alias("fold_count"), "methods", "status")


def grid_metrics(spark, path):
    grid = SM.candidate_grid(spark)
    return EV.summarize(SM.all_folds(anchor_series(spark, path, "revenue"), grid), ["entity", "model_id", "complexity"])


@query("FC32_smoothing_grid")
def fc32(spark, path):
    return rounded(grid_metrics(spark, path))


@query("FC32_grid_champion")
def fc32b(spark, path):
    return EV.champion(grid_metrics(spark, path), "model_id", groups=["entity"])


@query("FC32_grid_size", """SELECT entity, CAST(1082 AS BIGINT) AS candidates, CAST(1082 * (greatest(n - 24, 0) + greatest(n - 25, 0) + greatest(n - 26, 0)) AS BIGINT) AS folds FROM b_aser""")
def fc32c(spark, path):
    """Candidates and folds that the grid has for each anchor's history."""
    size = SM.candidate_grid(spark).agg((F.count(F.lit(1)) + len(SM.FIXED)).alias("candidates"))
    c = BacktestContract()
    folds = sum((F.greatest(F.col("n") - c.minimum_training_months - h + 1, F.lit(0)) for h in c.horizons), F.lit(0))
    return anchor_series(spark, path).crossJoin(F.broadcast(size)).select("entity", "candidates", (F.col("candidates") * folds).cast("long").alias("folds"))


def governed_rows(spark, path):
    return CH.governed_folds(anchor_series(spark, path, "revenue"), I.cal(spark, path))


_KUS = """SELECT entity, printf('%04d-%02d', (start_ord + a.o - 1) // 12, (start_ord + a.o - 1) % 12 + 1) AS origin_month, printf('%04d-%02d', (start_ord + a.o - 1 + k) // 12, (start_ord + a.o - 1 + k) % 12 + 1) AS target_month,
 CAST(k AS INT) AS horizon, a.hr[a.o + k] AS actual, greatest(CASE WHEN entity = 'GMA' THEN a.hr[a.o] ELSE a.hr[a.o + k - 12] * coalesce(d.w / p.w, 1) END, 0) AS prediction
 FROM (SELECT *, unnest(range(24, n)) AS o FROM b_aser WHERE entity IN ('GMA', 'KUS')) a JOIN range(1, 4) r(k) ON a.o + k <= n LEFT JOIN b_days d ON d.o = start_ord + a.o + k - 1 LEFT JOIN b_days p ON p.o = start_ord + a.o + k - 13"""


@query("FC27_governed_closed_form", f"SELECT * REPLACE (round(actual, 4) AS actual, round(prediction, 4) AS prediction) FROM ({_KUS})")
def fc27c(spark, path):
    """The two governed anchors whose method has a closed form: last month, and working-day seasonal."""
    r = governed_rows(spark, path).filter("entity in ('GMA', 'KUS')")
    return r.select("entity", "origin_month", "target_month", "horizon", F.round("actual", 4).alias("actual"), F.round("prediction", 4).alias("prediction"))


@query("E17_mixed_portfolio")
def e17(spark, path):
    return rounded(EV.summarize(governed_rows(spark, path), ["entity", "horizon"], [["entity"], ["horizon"], []]))


@query("FC27_governed_total")
def fc27t(spark, path):
    return rounded(EV.evaluation_scopes(materialize(governed_rows(spark, path)), ENTITIES))        # months x anchors x horizons, read three times


def example_rows(spark, path):
    return ML.examples(anchor_series(spark, path, "revenue"), FO.calendar_row(I.cal(spark, path)), method_column(), ("HMA", "GMA", "KUS"))


_FSEL = ["log_lag1", "log_lag12", "log_rolling3", "log_rolling6", "trend6", "volatility6", "seasonal_ratio", "zero_share12", "working_day_ratio"]
_MPORT = PORT.replace("h AS h, n", "hr AS h, n")


@query("M1_M2_features", f"""WITH f AS ({_MPORT}), s AS (SELECT f.*, a.start_ord, a.hr[:f.training_months] AS t FROM f JOIN b_aser a USING (entity)),
l AS (SELECT *, list_transform(t[-6:], lambda x: ln(1 + x)) AS y, start_ord + training_months + horizon - 1 AS tgt FROM s)
SELECT entity, origin_month, target_month, horizon, round(actual, 4) AS actual, round(prediction, 0) AS anchor, round(ln(1 + t[-1]), 6) AS log_lag1, round(ln(1 + t[-12]), 6) AS log_lag12, round(ln(1 + list_sum(t[-3:]) / 3), 6) AS log_rolling3,
 round(ln(1 + list_sum(t[-6:]) / 6), 6) AS log_rolling6, round(greatest(-1, least(1, list_sum(list_transform(y, lambda v, i: v * (i - 3.5::DOUBLE))) / 17.5::DOUBLE)), 6) AS trend6, round(list_stddev_pop(y), 6) AS volatility6,
 round(greatest(0, least(5, t[-1] / greatest(t[-12], 1))), 6) AS seasonal_ratio, round(len(list_filter(t[-12:], lambda x: x <= 0)) / 12.0, 6) AS zero_share12,
 round(greatest(0.5, least(1.5, coalesce(d1.w / d2.w, 1))), 6) AS working_day_ratio, round(abs(actual - prediction) - abs(actual - t[-1]), 0) AS gain_naive_last
FROM l LEFT JOIN b_days d1 ON d1.o = tgt LEFT JOIN b_days d2 ON d2.o = tgt - 12""")
def m1(spark, path):
    e = ML.improvements(example_rows(spark, path))
    return e.select("entity", "origin_month", "target_month", F.col("horizon").cast("int").alias("horizon"), F.round("actual", 4).alias("actual"), F.round("anchor", 0).alias("anchor"),
                    *[F.round(c, 6).alias(c) for c in _FSEL], F.round("gain_naive_last", 0).alias("gain_naive_last"))


@query("M7_synchronized_panel", "SELECT entity, start_ord, n, true AS in_range FROM b_aser")
def m7(spark, path):
    return ML.synchronized(anchor_series(spark, path)).select("entity", "start_ord", "n", "in_range")


def governed_examples(spark, path):
    return CH.governed_examples(anchor_series(spark, path, "revenue"), I.cal(spark, path))


def nested(spark, path, model):
    return CH.nested_folds(governed_examples(spark, path)).filter(F.col("model_id") == model)


@query("M3_M6_elastic_net")
def m3(spark, path):
    """Residual elastic net: refitted at every origin from the 24th month, scored on what came after."""
    return rounded(EV.summarize(nested(spark, path, CH.ELASTIC), ["entity", "horizon"], [["entity"], ["horizon"], []]))


@query("M5_nested_tree")
def m5(spark, path):
    """Policy tree: regrown at every origin from the 24th month, scored on what came after."""
    return rounded(EV.summarize(nested(spark, path, CH.TREE), ["entity", "horizon"], [["entity"], ["horizon"], []]))


def source_of(packed):
    """Fingerprint of the series that models learn from."""
    return SK.fingerprint(packed.select("entity", "start_ord", F.posexplode("h").alias("i", "v")).select("entity", "start_ord", "i", F.round("v", 2).alias("v")))


@query("M6_exact_source_inference")
def m6(spark, path):
    """A stored model answers only for the very table it was trained on."""
    p, cal = anchor_series(spark, path, "revenue"), I.cal(spark, path)
    stored = CH.stored_models(CH.governed_examples(p, cal), source_of(p))
    ahead = CH.governed_examples(p, cal, next_only=True)
    run = lambda tag, source: CH.stored_forecast(stored, source, ahead).withColumn("source", F.lit(tag))
    return rounded(run("same", source_of(p)).unionByName(run("other", source_of(p.filter("entity <> 'HMA'")))), ["prediction"])


def _strategy(name):
    def run(spark, path):
        p, cal = anchor_series(spark, path, "revenue"), I.cal(spark, path)
        stored = None if name == "reference_portfolio" else CH.stored_models(CH.governed_examples(p, cal), source_of(p))
        r = FO.resolve(p, cal, strategy=name, horizon=3, stored=stored, source=source_of(p))
        return r.select("entity", F.col("pick_model").alias("model"), "note", F.posexplode("pick_forecast").alias("step", "value")).withColumn("value", F.round("value", 3))
    return run


for _n in ("reference_portfolio", CH.TREE, CH.ELASTIC):
    query(f"FC26_strategy_{_n}")(_strategy(_n))


@query("M4_policy_tree")
def m4(spark, path):
    return CH.leaves(governed_examples(spark, path)).withColumn("error", F.round("error", 4))


@query("M8_challenger_backtest")
def m8c(spark, path):
    return rounded(ML.entity_backtest(nested(spark, path, CH.TREE)))


@query("M8_entity_backtest", f"""WITH f AS ({PORT}), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY target_month DESC) AS k FROM f WHERE horizon = 1)
SELECT {metrics_sql('entity,')} FROM k WHERE k <= 6 GROUP BY entity""")
def m8(spark, path):
    return rounded(ML.entity_backtest(portfolio_rows(spark, path)))


@query("H8_forecast_center", """SELECT level, month, count(*) AS series, round(sum(value), 4) AS value FROM (SELECT 'brand' AS level, month, value FROM b_brandfc UNION ALL SELECT 'model', month, value FROM b_ma
 UNION ALL SELECT 'plc', month, value FROM b_pa) GROUP BY ALL""")
def h8(spark, path):
    c = Center(spark, path)
    levels = [c.brand.select(F.lit("brand").alias("level"), "month", "value"), c.model.select(F.lit("model").alias("level"), "month", "value"), c.plc.select(F.lit("plc").alias("level"), "month", "value")]
    u = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return u.groupBy("level", "month").agg(F.count(F.lit(1)).alias("series"), F.round(F.sum("value"), 4).alias("value"))


@query("H11_evaluation_report")
def h11(spark, path):
    f = materialize(I.facts(spark, path).select("month", "brand", "anchor_brand", "anchor_method", "entity_key", "plc", "part_number", "quantity", "revenue",
                                                "wholesale_units", "working_days"))           # two sections read it
    one = lambda df, tag, cols: df.select(F.lit(tag).alias("section"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x")).select("section", "x.*")
    life = FA.lifecycle(I.sales(spark, path), cutoff_year=2000).groupBy("status_code").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("lifecycle").alias("section"), F.col("status_code").alias("name"), F.col("n").cast("string").alias("value"))
    anchors = FA.anchor_policy_summary(f).select(F.lit("anchors").alias("section"), F.col("anchor_method").alias("name"), F.col("share_pct").cast("string").alias("value"))
    return one(FA.fact_summary(f), "facts", ["row_count", "month_count", "total_quantity", "exact_quantity_pct"]).unionByName(life).unionByName(anchors)


# --- the forecast center as one cube ------------------------------------------------------------

block("b_brandrev", f"""SELECT entity AS brand, printf('%04d-%02d', ({CO} + k) // 12, ({CO} + k) % 12 + 1) AS month, {CO} + k AS o, {Q.path('h', 'trailing_12_mean', 3)}[k] AS value FROM b_aserr, range(1, 4) t(k)""")
alloc_blocks("mr", MODEL, ["brand"], "b_brandrev", "revenue")
alloc_blocks("pv", PLC, MODEL, "b_mr", "revenue")


class RevenueCenter(Center):
    """The levels of a run whose brands are forecast in revenue."""

    @cached_property
    def brand(self):
        return materialize(brand_forecast(self.levels.select("brand", "month", F.col("revenue").alias("quantity"))))


def center_cube(spark, path, c, value):
    latest = I.sales(spark, path).agg(F.max("sale_date").alias("latest_date"))
    plain = c.brand.select("brand", "horizon", "month", "value")
    now = FO.nowcast(plain, c.facts, latest, c.cal, value=value)
    series = S.pack(c.facts, ["brand"], F.col(value).cast("double"), end=CUTOFF)
    bounds = EV.intervals(now.select("brand", "horizon", "month", F.col("value").alias("point")), EV.folds(series, ["brand"], "trailing_12_mean"), ["brand"])
    actual = c.facts.filter(F.col("month") <= CUTOFF).groupBy(*CC.LEAF, "month").agg(F.sum(F.col(value).cast("double")).alias("value"))
    return CC.cube(actual, c.plc, now, bounds.select("brand", "month", "lower", "upper", "status"))


def center_sql(column, series, brands, leaves):
    ks = ", ".join(CC.LEAF)
    sets = ", ".join("(" + ", ".join(["surface", "month", *keys]) + ")" for keys in CC.LEVELS.values())
    level = "CASE GROUPING(" + ks + ") " + " ".join(f"WHEN {CC._level_code(keys)} THEN '{name}'" for name, keys in CC.LEVELS.items()) + " END"
    return f"""WITH d AS (SELECT max(sale_date) AS d FROM b_sales),
n AS (SELECT strftime(d, '%Y-%m') AS now_month, d < last_day(d) AS open, (SELECT count(*) FROM range(1, 32) t(i) WHERE i <= day(d) AND isodow(CAST(strftime(d, '%Y-%m') || '-01' AS DATE) + (i - 1)::INT) <= 5) / (SELECT working_days FROM b_cal WHERE month = strftime(d, '%Y-%m')) AS completion FROM d),
m AS (SELECT brand, month, sum({column}) AS atd FROM b_hf GROUP BY ALL),
w AS (SELECT f.brand, f.month, f.o - {CO} AS horizon, f.value AS baseline, CASE WHEN f.month = now_month AND open THEN 'nowcast' ELSE 'forecast' END AS surface,
  CASE WHEN f.month = now_month AND open THEN greatest(0, coalesce(atd, 0) + (1 - completion) * f.value) ELSE f.value END AS nv FROM {brands} f CROSS JOIN n LEFT JOIN m ON f.brand = m.brand AND f.month = m.month),
fo AS ({folds_sql(series, 'entity', 'trailing_12_mean')}),
r AS (SELECT w.brand, w.month, list_sort(list(abs(fo.actual - fo.prediction))) AS rs, count(*) AS k FROM w JOIN fo ON fo.entity = w.brand AND fo.horizon = w.horizon AND fo.target_month < w.month GROUP BY ALL),
b AS (SELECT w.*, coalesce(k, 0) >= 5 AS validated, greatest(0, nv - coalesce(rs[ceil(0.9::DOUBLE * (k - 1))::INT + 1], 0)) AS lo, nv + coalesce(rs[ceil(0.9::DOUBLE * (k - 1))::INT + 1], 0) AS hi FROM w LEFT JOIN r USING (brand, month)),
l AS (SELECT surface, {', '.join('p.' + k for k in CC.LEAF)}, p.month, p.value * CASE WHEN baseline > 0 THEN nv / baseline ELSE 0 END AS v, nv, lo, hi, validated FROM {leaves} p JOIN b USING (brand, month)),
x AS (SELECT 'actual' AS surface, {ks}, month, sum({column}) AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, NULL::BOOLEAN AS validated FROM b_hf WHERE month <= '{CUTOFF}' GROUP BY ALL
 UNION ALL SELECT surface, {ks}, month, v, least(v, greatest(0, lo * CASE WHEN nv > 0 THEN v / nv ELSE 0 END)), greatest(v, hi * CASE WHEN nv > 0 THEN v / nv ELSE 0 END), validated FROM l)
SELECT surface, {level} AS level, {', '.join(f"coalesce({k}, '') AS {k}" for k in CC.LEAF)}, month, CASE WHEN surface = 'actual' THEN round(sum(value), 5) ELSE round(sum(value), 3) END AS value, round(sum(lower), 3) AS lower, round(sum(upper), 3) AS upper, bool_and(validated) AS validated, count(*) AS leaves
FROM x GROUP BY GROUPING SETS ({sets})"""


#: Actuals are sums of four decimals, which rounding to three would leave to chance.
_cells = lambda df: df.withColumns({k: F.when(F.col("surface") == "actual", F.round(k, 5)).otherwise(F.round(k, 3)) for k in ("value", "lower", "upper")})


@query("H8_center_quantity", center_sql("quantity", "b_aser", "b_brandfc", "b_pa"))
def h8q(spark, path):
    return _cells(center_cube(spark, path, Center(spark, path), "quantity"))


@query("H8_center_revenue", center_sql("revenue", "b_aserr", "b_brandrev", "b_pv"))
def h8r(spark, path):
    return _cells(center_cube(spark, path, RevenueCenter(spark, path, "revenue"), "revenue"))
