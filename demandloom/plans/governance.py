"""Queries: name conflicts and seven families of business checks, registered evidence, governance row, reconciliation roll-up."""

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import facts as FA
from ..operators import governance as G
from ..operators import hierarchy as HI
from ..session import materialize
from . import inputs as I
from .base_sql import block
from .evaluate import ENTITIES, METHOD, PORT, anchor_series, method_column, portfolio_rows
from .facts import BASKET
from .govern import _PATH, RevenueCenter, source_of
from .hierarchy import CO, CUTOFF, MODEL, Center, _gap, alloc_blocks
from .registry import query


@query("H9_mapping_conflicts", """SELECT model_key AS component, count(*) AS names, coalesce(string_agg(anchor_brand, ',' ORDER BY anchor_brand) FILTER (units > 0), '') AS anchors, sum(units) AS units,
 count(*) FILTER (units > 0) > 1 AS conflict FROM (SELECT model_key, anchor_brand, sum(wholesale_units) AS units FROM b_wl GROUP BY ALL) GROUP BY model_key""")
def h9c(spark, path):
    """Names carry the power-train suffix of their anchor, so that only a shared spelling ties them."""
    suffix = F.when(F.col("anchor_brand") == "HMA", " HYBRID").when(F.col("anchor_brand") == "GMA", " EV").otherwise("")
    return G.mapping_conflicts(I.wl(spark, path).withColumn("model_key", F.concat("model_key", suffix)))


@query("H9_validation_families", f"""SELECT 'anchor_set' AS "check", CASE WHEN count(DISTINCT brand) FILTER (brand NOT IN ('HMA', 'GMA', 'KUS')) = 0 AND count(*) > 0 THEN 'PASS' ELSE 'WARN' END AS status, count(DISTINCT brand) AS measure FROM b_brandfc
UNION ALL SELECT 'shared_cutoff', CASE WHEN max(sale_date) IS NOT NULL THEN 'PASS' ELSE 'WARN' END, count(sale_date) FROM b_sales
UNION ALL SELECT 'reconciliation', CASE WHEN greatest({_gap('b_ma', 'b_pa', MODEL)}, {_gap('b_brandfc', 'b_ma', ['brand'])}) <= 0.01 THEN 'PASS' ELSE 'FAIL' END, (SELECT count(*) FROM b_ma) + (SELECT count(*) FROM b_brandfc)
UNION ALL SELECT 'non_negative', CASE WHEN count(*) FILTER (quantity < 0) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (quantity < 0) FROM b_sales
UNION ALL SELECT 'wholesale_denominator', CASE WHEN count(*) FILTER (wholesale_units > 0) > 0 THEN 'PASS' ELSE 'WARN' END, count(*) FILTER (wholesale_units > 0) FROM b_wl
UNION ALL SELECT 'channel_baskets', CASE WHEN count(*) = 0 THEN 'WARN' ELSE 'PASS' END, count(DISTINCT month) FROM b_factsraw WHERE anchor_brand = 'KUS' AND month >= '{BASKET.effective_month}'
UNION ALL SELECT 'model_mapping', CASE WHEN count(*) FILTER (anchor_method IN ('genesis_name_fallback', 'hma_default_fallback')) = 0 THEN 'PASS' ELSE 'WARN' END, count(*) FILTER (anchor_method IN ('genesis_name_fallback', 'hma_default_fallback')) FROM b_factsraw""")
def h9f(spark, path):
    c, wl, f = Center(spark, path), I.wl(spark, path), I.facts(spark, path, model_year=True)
    same = [HI.reconciliation(c.brand, c.model, ["brand"]), HI.reconciliation(c.model, c.plc, MODEL)]
    return G.validation(c.brand, I.sales(spark, path), wl, f, FA.channel_baskets(f, wl, BASKET), same, BASKET.effective_month)


def span_of(packed):
    return packed.agg(F.min("start_ord").alias("start_ord"), F.max("n").alias("months"))


_KEYS = "SELECT DISTINCT origin_month, target_month, horizon FROM "
_HASH = """count(*) AS fold_keys, sha256('[' || coalesce(string_agg('{"horizon":' || horizon || ',"originMonth":"' || origin_month || '","targetMonth":"' || target_month || '"}', ',' ORDER BY origin_month, horizon), '') || ']') AS identity"""
block("b_port", PORT)
block("b_wantkeys", """SELECT printf('%04d-%02d', (s + o - 1) // 12, (s + o - 1) % 12 + 1) AS origin_month, printf('%04d-%02d', (s + o - 1 + h) // 12, (s + o - 1 + h) % 12 + 1) AS target_month, h AS horizon
 FROM (SELECT min(start_ord) AS s, max(n) AS n FROM b_aser), range(24, 1200) t(o), range(1, 4) r(h) WHERE o + h <= n""")


@query("E11_F23_fold_identity", f"""SELECT 'observed' AS folds, {_HASH} FROM ({_KEYS} b_port) UNION ALL SELECT 'expected', {_HASH} FROM b_wantkeys
UNION ALL SELECT 'observed_from_1998', {_HASH} FROM ({_KEYS} b_port WHERE origin_month >= '1998-01')""")
def e11i(spark, path):
    rows, span = portfolio_rows(spark, path), span_of(anchor_series(spark, path))
    tag = lambda df, name: df.select(F.lit(name).alias("folds"), "fold_keys", "identity")
    return tag(G.observed_identity(rows), "observed").unionByName(tag(G.expected_identity(span), "expected")).unionByName(
        tag(G.observed_identity(rows.filter("origin_month >= '1998-01'")), "observed_from_1998"))


REGISTERED = G.Request(cutoff=CUTOFF)


def gate(spark, path, request=REGISTERED, keep="true"):
    packed = materialize(anchor_series(spark, path))
    rows = materialize(portfolio_rows(spark, path).filter(keep))
    return G.evidence_gate(rows, span_of(packed), source_of(packed.filter(keep)), request, REGISTERED, source_of(packed), ENTITIES)


def _gate_sql(tag, keep, filtered):
    f, no = f"(SELECT * FROM b_port WHERE {keep})", "false" if filtered else "true"
    return f"""SELECT '{tag}' AS request, "check", passed FROM (UNPIVOT (SELECT *, full_scope AND source AND target AND strategy AND cutoff AND entities AND unfiltered AND request_cutoff AND contract_version AND horizons AND minimum_training
 AND fold_counts AND fold_key_count AND fold_identity AND prediction_coverage AND full_coverage AND no_leak AS "all" FROM (SELECT {no} AND e = 'GMA,HMA,KUS' AS full_scope, src AS source, true AS target, true AS strategy, last = '{CUTOFF}' AS cutoff,
 e = 'GMA,HMA,KUS' AS entities, {no} AS unfiltered, true AS request_cutoff, true AS contract_version, hs = '1,2,3' AS horizons, least_months = 24 AS minimum_training, fc AS fold_counts, fold_keys = want_keys AS fold_key_count,
 identity = want AS fold_identity, made = n AS prediction_coverage, whole AS full_coverage, leaks = 0 AS no_leak FROM
 (SELECT string_agg(DISTINCT entity, ',' ORDER BY entity) AS e, max(target_month) AS last, string_agg(DISTINCT CAST(horizon AS VARCHAR), ',' ORDER BY CAST(horizon AS VARCHAR)) AS hs, min(training_months) AS least_months, count(prediction) AS made,
  count(*) AS n, count(*) FILTER (target_month <= origin_month) AS leaks FROM {f}), (SELECT {_HASH} FROM ({_KEYS} {f})), (SELECT count(*) AS want_keys, any_value(identity) AS want FROM (SELECT {_HASH} FROM b_wantkeys), b_wantkeys),
 (SELECT bool_and(k = 3) AS whole FROM (SELECT count(*) AS k FROM {f} GROUP BY origin_month, target_month, horizon)),
 (SELECT (SELECT list(h ORDER BY entity) FROM b_aser WHERE {keep}) = (SELECT list(h ORDER BY entity) FROM b_aser) AS src),
 (SELECT count(DISTINCT origin_month) FILTER (horizon = 1) = any_value(m) - 24 AND count(DISTINCT origin_month) FILTER (horizon = 2) = any_value(m) - 25 AND count(DISTINCT origin_month) FILTER (horizon = 3) = any_value(m) - 26 AS fc FROM {f}, (SELECT max(n) AS m FROM b_aser))))
 ON full_scope, source, target, strategy, cutoff, entities, unfiltered, request_cutoff, contract_version, horizons, minimum_training, fold_counts, fold_key_count, fold_identity, prediction_coverage, full_coverage, no_leak, "all" INTO NAME "check" VALUE passed)"""


@query("E11_registered_evidence", _gate_sql("whole", "true", False) + " UNION ALL " + _gate_sql("filtered", "entity = 'HMA'", True))
def e11r(spark, path):
    whole = gate(spark, path).withColumn("request", F.lit("whole"))
    part = gate(spark, path, G.Request(cutoff=CUTOFF, filtered=True), "entity = 'HMA'").withColumn("request", F.lit("filtered"))
    return whole.unionByName(part)


@query("E16_governance", f"""SELECT 'fixed_portfolio' AS strategy, max(target_month) AS cutoff, string_agg(DISTINCT CAST(horizon AS VARCHAR), ',' ORDER BY CAST(horizon AS VARCHAR)) AS horizons,
 (SELECT count(*) FROM ({_KEYS} b_port)) AS fold_count, (SELECT identity FROM (SELECT {_HASH} FROM ({_KEYS} b_port))) AS fold_identity,
 '{",".join(f"{e}={METHOD[e]}" for e in ENTITIES)}' AS methods, CASE WHEN (SELECT identity FROM (SELECT {_HASH} FROM ({_KEYS} b_port))) = (SELECT identity FROM (SELECT {_HASH} FROM b_wantkeys))
 AND count(prediction) = count(*) THEN 'validated' ELSE 'unvalidated_request_scope' END AS status FROM b_port""")
def e16g(spark, path):
    rows, packed = materialize(portfolio_rows(spark, path)), anchor_series(spark, path)
    m = packed.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "entity", method_column()))), ",").alias("methods"))             # governed anchors
    s = rows.agg(F.max("target_month").alias("cutoff"), F.array_join(F.array_sort(F.collect_set(F.col("horizon").cast("string"))), ",").alias("horizons"))
    passed = gate(spark, path).filter("check = 'all'").select("passed")
    i = G.observed_identity(rows)
    return s.crossJoin(i).crossJoin(m).crossJoin(passed).select(                                             # one-row tables
        F.lit(REGISTERED.strategy).alias("strategy"), "cutoff", "horizons", F.col("fold_keys").alias("fold_count"), F.col("identity").alias("fold_identity"), "methods",
        F.when(F.col("passed"), "validated").otherwise("unvalidated_request_scope").alias("status"))


class WholesaleCenter(Center):
    """Brand and model levels of vehicle volumes."""

    @cached_property
    def levels(self):
        w = I.wl(self.spark, self.path)
        return materialize(w.select(F.col("anchor_brand").alias("brand"), F.concat_ws("::", "anchor_brand", "model_key").alias("entity_key"), F.col("model_key").alias("model_name"), "month",
                                    (F.col("wholesale_units") + F.col("fleet_units")).alias("quantity"), F.lit(0.0).alias("revenue"), F.lit("active").alias("lifecycle_code")))


block("b_whf", """SELECT month, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, anchor_brand AS brand, anchor_brand || '::' || model_key AS entity_key, model_key AS model_name,
 wholesale_units + fleet_units AS quantity, 0.0::DOUBLE AS revenue, 'active' AS code FROM b_wl""")
block("b_brandwh", _PATH("b_aserw").replace("AS value FROM", f"AS value, {CO} + k AS o FROM"))
alloc_blocks("mw", MODEL, ["brand"], "b_brandwh", "quantity", facts="b_whf")


def _steps(*pairs):
    """(max_delta, checked) over reconciliation steps, as SQL."""
    gap = ", ".join(_gap(a, b, k) for a, b, k in pairs)
    return f"SELECT round(greatest({gap}, 0), 6) AS max_delta, {' + '.join(f'(SELECT count(*) FROM {a})' for a, _, _ in pairs)} AS checked"


_ROLL = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", * FROM ({_steps(*p)})" for n, p in {
    "revenue": [("b_brandrev", "b_mr", ["brand"]), ("b_mr", "b_pv", MODEL)], "quantity": [("b_brandfc", "b_ma", ["brand"]), ("b_ma", "b_pa", MODEL)],
    "wholesale": [("b_brandwh", "b_mw", ["brand"])]}.items())


@query("A30_quality_rollup", f"""WITH r AS ({_ROLL}) SELECT "check", CASE WHEN max_delta <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status, max_delta, 0.01::DOUBLE AS tolerance, checked FROM r
UNION ALL SELECT 'MODEL_STATUS', CASE WHEN max(max_delta) <= 0.01 THEN 'PASS' ELSE 'FAIL' END, max(max_delta), 0.01::DOUBLE, CAST(sum(checked) AS BIGINT) FROM r""")
def a30(spark, path):
    both = lambda c: [HI.reconciliation(c.brand, c.model, ["brand"]), HI.reconciliation(c.model, c.plc, MODEL)]
    w, q, v = WholesaleCenter(spark, path), Center(spark, path, parts=None), RevenueCenter(spark, path, "revenue", None)
    v.levels = q.levels              # both metrics are in the same months
    r = G.rollup({"revenue": both(v), "quantity": both(q), "wholesale": [HI.reconciliation(w.brand, w.model, ["brand"])]})
    return r.withColumn("max_delta", F.round("max_delta", 6))
