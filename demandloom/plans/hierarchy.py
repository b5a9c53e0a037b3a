"""Queries: allocation, part plans, reconciliation, allocation accuracy, exceptions (H*, A25, A26, A28, T5, E7, E8)."""

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import forecast as FC
from ..operators import evaluate as EV
from ..operators import forecasting as FO
from ..operators import hierarchy as HI
from ..operators import series as S
from ..session import materialize
from . import inputs as I
from . import series_sql as Q
from .base_sql import block
from .evaluate import METRICS, metrics_sql, rounded
from .registry import query

CUTOFF, CO = "2001-10", 2001 * 12 + 9
MODEL, PLC = ["brand", "entity_key", "model_name"], ["brand", "entity_key", "model_name", "plc"]
LOW = 45.0
r5 = lambda *cs: [F.round(c, 5).alias(c) for c in cs]


def governed_facts(spark, path):
    """Facts by governed anchor. Names of the test tables stand in for lifecycle states, so that
    every route occurs: names on 'ring' are discontinued, names beginning with 'small' are new."""
    f = I.anchored_sales(spark, path)
    code = F.when(F.col("model_name").endswith("ring"), "discontinued").when(F.col("model_name").startswith("small"), "new").otherwise("active")
    return f.withColumn("brand", F.col("anchor_brand")).withColumn("entity_key", F.concat_ws("::", "anchor_brand", "model_key")).withColumn("lifecycle_code", code)


def facts(spark, path):
    """The same in storage, for queries that read them several times."""
    return materialize(governed_facts(spark, path))


class Center:
    """The levels of one planning run, each built once and only when asked for.

    ``parts``: what is read at part level. 'described' stores the facts as they are, 'plain' without the descriptions, None does not
    store them: the upper levels need their months only.
    """

    def __init__(self, spark, path, metric="quantity", parts="described"):
        self.spark, self.path, self.metric, self.parts = spark, path, metric, parts
        self.cal = I.cal(spark, path)

    @cached_property
    def facts(self):
        return facts(self.spark, self.path) if self.parts == "described" else materialize(governed_facts(self.spark, self.path).drop("part_description"))

    @cached_property
    def levels(self):
        """Months of the PLCs, from which the upper levels are built."""
        return materialize(HI.level_months(self.facts if self.parts else governed_facts(self.spark, self.path), PLC))

    @cached_property
    def brand(self):
        return materialize(brand_forecast(self.levels))

    @cached_property
    def model(self):
        return materialize(HI.allocate(self.levels, self.brand, self.cal, child=MODEL, parent=["brand"], cutoff=CUTOFF, metric=self.metric, min_volume=LOW))

    @cached_property
    def plc(self):
        return materialize(HI.allocate(self.levels, self.model, self.cal, child=PLC, parent=MODEL, cutoff=CUTOFF, metric=self.metric, min_volume=LOW))


def brand_forecast(facts):
    p = S.pack(facts, ["brand"], F.col("quantity"), end=CUTOFF).select(
        "brand", "start_ord", F.col("n").alias("history_months"), FC.path(F.col("h"), "trailing_12_mean", 3).alias("forecast"))
    return FO.forecast_long(p, ["brand"]).withColumn("forecast_type", F.lit("Forecast"))


block("b_hf", """SELECT month, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, anchor_brand AS brand, anchor_brand || '::' || model_key AS entity_key, model_name, plc, part_number, part_description,
 quantity, CAST(revenue AS DOUBLE) AS revenue, CASE WHEN model_name LIKE '%ring' THEN 'discontinued' WHEN model_name LIKE 'small%' THEN 'new' ELSE 'active' END AS code FROM b_factsraw""")
block("b_brandfc", f"""SELECT entity AS brand, printf('%04d-%02d', ({CO} + k) // 12, ({CO} + k) % 12 + 1) AS month, {CO} + k AS o, {Q.path('h', 'trailing_12_mean', 3)}[k] AS value FROM b_aser, range(1, 4) t(k)""")
block("b_days", "SELECT CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, working_days AS w FROM b_cal")


def alloc_blocks(tag, child, parent, parent_block, metric, facts="b_hf"):
    ch, pa = ", ".join(child), ", ".join(parent)
    eq = lambda a, b, ks: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    block(f"b_{tag}m", f"SELECT {ch}, o, sum(quantity) AS q, sum(revenue) AS r, min(code) AS code FROM {facts} WHERE month <= '{CUTOFF}' GROUP BY ALL")
    block(f"b_{tag}c", f"""SELECT *, CASE WHEN code IN ('discontinued', 'inactive') THEN 'excluded_lifecycle' WHEN code IN ('new', 'reintroduced') OR hm < 18 THEN CASE WHEN avgq >= {LOW} THEN 'new_model_proxy' ELSE 'excluded_low_volume' END
  WHEN act < 6 OR avgq < {LOW} THEN 'excluded_low_volume' ELSE 'regular_allocation' END AS route FROM (SELECT *, hq / hm AS avgq FROM (
  SELECT {ch}, min(code) AS code, sum(q) AS hq, sum(r) AS hr, count(*) FILTER (q > 0) AS act, max(o) AS last, greatest(1, {CO} - min(o) + 1) AS hm,
   list(q ORDER BY o) AS lq, list(r ORDER BY o) AS lr FROM b_{tag}m GROUP BY ALL))""")
    block(f"b_{tag}p", f"""SELECT c.*, coalesce(CASE WHEN list_sum(lq[-3:]) > 0 AND list_sum(lr[-3:]) > 0 THEN list_sum(lr[-3:]) / list_sum(lq[-3:]) END, CASE WHEN hq > 0 AND hr > 0 THEN hr / hq END, greatest(pp.price, 0), 0) AS unit_price
 FROM b_{tag}c c LEFT JOIN (SELECT {pa}, CASE WHEN sum(q) > 0 THEN sum(r) / sum(q) ELSE 0 END AS price FROM b_{tag}m WHERE o >= {CO - 5} GROUP BY ALL) pp USING ({pa})""")
    block(f"b_{tag}s", f"""SELECT c.*, p.month, p.o AS ot, p.value AS pv, coalesce(fd.w, (SELECT avg(w) FROM b_days)) AS fut FROM b_{tag}p c JOIN {parent_block} p USING ({pa}) LEFT JOIN b_days fd ON fd.o = p.o""")
    look = "CASE WHEN s.route = 'regular_allocation' THEN 6 ELSE 3 END"
    block(f"b_{tag}r", f"""SELECT s.*, sum(m.q) FILTER (m.o > s.last - {look}) / any_value({look}) AS rb,
  (SELECT avg(w) FROM b_days d WHERE d.o > s.last - {look} AND d.o <= s.last) AS rd, count(*) FILTER (m.o % 12 = s.ot % 12) AS ns, avg(m.q) FILTER (m.o % 12 = s.ot % 12) AS sb, avg(dd.w) FILTER (m.o % 12 = s.ot % 12) AS sd
  FROM b_{tag}s s JOIN b_{tag}m m ON {eq('s', 'm', child)} LEFT JOIN b_days dd ON dd.o = m.o GROUP BY ALL""")
    price = " * greatest(unit_price, 0)" if metric == "revenue" else ""
    block(f"b_{tag}x", f"""SELECT *, CASE WHEN route LIKE 'excluded%' THEN 0 ELSE greatest(0, CASE WHEN route = 'regular_allocation' AND ns >= 2 THEN sb * (fut / sd) * 0.6::DOUBLE + rb * (fut / rd) * 0.4::DOUBLE ELSE rb * (fut / rd) END{price}) END AS raw,
  CASE WHEN route LIKE 'excluded%' THEN 0 ELSE {'hr' if metric == 'revenue' else 'hq'} END AS hist, CASE WHEN route LIKE 'excluded%' THEN 0 ELSE 1 END AS el FROM b_{tag}r""")
    fill = ", ".join(k if k in parent else f"brand || '::PLANNER_REVIEW_RESIDUAL' AS {k}" if k == "entity_key" else f"'Planner review residual' AS {k}" for k in child)
    block(f"b_{tag}", f"""SELECT {ch}, month, ot AS o, route, CASE WHEN rt > 0 THEN raw WHEN en = 0 THEN 0 WHEN ht > 0 THEN hist ELSE el END * coalesce(pv / nullif(CASE WHEN rt > 0 THEN rt WHEN en = 0 THEN 0 WHEN ht > 0 THEN ht ELSE en END, 0), 0) AS value,
  coalesce(CASE WHEN rt > 0 THEN raw WHEN en = 0 THEN 0 WHEN ht > 0 THEN hist ELSE el END / nullif(CASE WHEN rt > 0 THEN rt WHEN en = 0 THEN 0 WHEN ht > 0 THEN ht ELSE en END, 0), 0) AS share, unit_price, hq, avgq
 FROM (SELECT *, sum(raw) OVER w AS rt, sum(hist) OVER w AS ht, sum(el) OVER w AS en FROM b_{tag}x WINDOW w AS (PARTITION BY {pa}, month))
 UNION ALL SELECT {fill}, month, o, 'planner_review_residual', value, 1.0, 0, 0, 0 FROM {parent_block} p WHERE NOT EXISTS (SELECT 1 FROM b_{tag}x x WHERE {eq('x', 'p', parent)} AND el = 1)""")


alloc_blocks("ma", MODEL, ["brand"], "b_brandfc", "quantity")
alloc_blocks("pa", PLC, MODEL, "b_ma", "quantity")
alloc_blocks("mv", MODEL, ["brand"], "b_brandfc", "revenue")


@query("H2_H3_H4_model_allocation", "SELECT brand, entity_key, model_name, month, route, round(value, 5) AS value, round(share, 8) AS share FROM b_ma")
def h4(spark, path):
    return Center(spark, path, parts=None).model.select(*MODEL, "month", "route", *r5("value"), F.round("share", 8).alias("share"))


@query("H3_A25_revenue_signal_allocation", "SELECT brand, entity_key, model_name, month, round(value, 5) AS value, round(unit_price, 5) AS unit_price FROM b_mv")
def h3(spark, path):
    return Center(spark, path, "revenue", None).model.select(*MODEL, "month", *r5("value", "unit_price"))


@query("H4_plc_allocation", "SELECT brand, entity_key, model_name, plc, month, route, round(value, 5) AS value FROM b_pa")
def h4b(spark, path):
    return Center(spark, path, parts=None).plc.select(*PLC, "month", "route", *r5("value"))


@query("A28_routing_summary", """SELECT 'model' AS level, route, count(*) AS series FROM (SELECT DISTINCT entity_key, route FROM b_ma) GROUP BY route
UNION ALL SELECT 'plc', route, count(*) FROM (SELECT DISTINCT entity_key, plc, route FROM b_pa) GROUP BY route""")
def a28(spark, path):
    c = Center(spark, path, parts=None)
    return HI.routing_summary({"model": c.model, "plc": c.plc}, {"model": MODEL, "plc": PLC})


def _gap(parents, children, keys):
    """Largest gap between a parent's value and the sum of its children's, as SQL."""
    ks = ", ".join([*keys, "month"])
    return f"(SELECT max(abs(p.value - coalesce(c.value, 0))) FROM {parents} p LEFT JOIN (SELECT {ks}, sum(value) AS value FROM {children} GROUP BY ALL) c USING ({ks}))"


@query("H6_reconciliation", f"""SELECT 'model_to_plc' AS step, (SELECT count(*) FROM b_ma) AS checked, CASE WHEN {_gap('b_ma', 'b_pa', MODEL)} <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status
UNION ALL SELECT 'brand_to_model', (SELECT count(*) FROM b_brandfc), CASE WHEN {_gap('b_brandfc', 'b_ma', ['brand'])} <= 0.01 THEN 'PASS' ELSE 'FAIL' END""")
def h6(spark, path):
    c = Center(spark, path, parts=None)
    a = HI.reconciliation(c.model, c.plc, MODEL).withColumn("step", F.lit("model_to_plc"))
    b = HI.reconciliation(c.brand, c.model, ["brand"]).withColumn("step", F.lit("brand_to_model"))
    return a.unionByName(b).select("step", "checked", "status")


@query("H10_demand_preview", "SELECT brand, model_name, plc, min(route) AS route, round(arg_min(value, month), 5) AS next_demand, round(sum(value), 5) AS total_demand FROM b_pa GROUP BY ALL")
def h10(spark, path):
    p = Center(spark, path, parts=None).plc
    return p.groupBy("brand", "model_name", "plc").agg(F.min("route").alias("route"), F.round(F.min_by("value", "month"), 5).alias("next_demand"), F.round(F.sum("value"), 5).alias("total_demand"))


@query("T5_top_plcs", f"""WITH h AS (SELECT plc, sum(revenue) AS hr FROM b_hf WHERE month <= '{CUTOFF}' GROUP BY plc), f AS (SELECT plc, month, sum(value) AS value FROM b_pa GROUP BY ALL),
k AS (SELECT plc, coalesce(hr, 0) AS hr, row_number() OVER (ORDER BY round(coalesce(hr, 0), 2) DESC, plc) AS rank FROM (SELECT DISTINCT plc FROM f) LEFT JOIN h USING (plc))
SELECT plc, CAST(rank AS INT) AS rank, round(hr, 2) AS history_revenue, round(hr / (SELECT sum(hr) FROM h) * 100, 6) AS share_pct, month, round(value, 5) AS value FROM k JOIN f USING (plc) WHERE rank <= 4""")
def t5(spark, path):
    c = Center(spark, path)
    t = HI.top_plcs(c.facts, c.plc, CUTOFF, 4)
    return t.select("plc", "rank", F.round("history_revenue", 2).alias("history_revenue"), F.round("share_pct", 6).alias("share_pct"), "month", *r5("value"))


PART_MIN = 12.0
block("b_part0", f"""SELECT f.brand, f.entity_key, f.plc, part_number, part_description, any_value(l.last) AS last,
 coalesce(sum(quantity) FILTER (o >= {CO - 5}), 0) AS rq, coalesce(sum(revenue) FILTER (o >= {CO - 5}), 0) AS rr, coalesce(sum(quantity) FILTER (month = l.last), 0) AS lq,
 count(DISTINCT o) FILTER (quantity > 0) AS act, sum(quantity) / greatest(1, {CO} - min(o) + 1) AS av, count(*) FILTER (o >= {CO - 5} OR month = l.last) AS seen, any_value(rt.route) AS route
 FROM b_hf f JOIN (SELECT brand, entity_key, plc, max(month) AS last FROM b_hf WHERE month <= '{CUTOFF}' GROUP BY ALL) l USING (brand, entity_key, plc)
 JOIN (SELECT brand, entity_key, plc, min(route) AS route FROM b_pa GROUP BY ALL) rt USING (brand, entity_key, plc)
 WHERE month <= '{CUTOFF}' GROUP BY ALL""")


def part_blocks(tag, unit):
    block(f"b_{tag}0", f"""SELECT *, CASE WHEN route = 'new_model_proxy' THEN rq > 0 AND av >= {PART_MIN} ELSE act >= 6 AND av >= {PART_MIN} END AS ok, lq * {unit} AS wl, rq * {unit} AS wr,
 CASE WHEN rq > 0 THEN rr / rq ELSE 0 END AS unit FROM b_part0 WHERE seen > 0""")
    block(f"b_{tag}1", f"""SELECT *, CASE WHEN al > 0 THEN wl / nullif(ol, 0) ELSE wr / nullif(orr, 0) END AS sh FROM (SELECT *, sum(wl) OVER w AS al, sum(CASE WHEN ok THEN wl ELSE 0 END) OVER w AS ol, sum(CASE WHEN ok THEN wr ELSE 0 END) OVER w AS orr
 FROM b_{tag}0 WINDOW w AS (PARTITION BY brand, entity_key, plc)) WHERE ok""")
    block(f"b_{tag}", f"""SELECT s.brand, s.entity_key, s.plc, s.part_number, p.month, s.route, s.sh AS share, p.value * s.sh AS value, s.unit FROM b_{tag}1 s JOIN b_pa p USING (brand, entity_key, plc) WHERE sh IS NOT NULL
 UNION ALL SELECT brand, entity_key, plc, 'PLANNER_REVIEW', month, 'planner_review_residual', 1.0, value, 0 FROM b_pa p WHERE (brand, entity_key, plc) IN (SELECT (brand, entity_key, plc) FROM b_pa GROUP BY ALL HAVING max(value) > 0)
 AND NOT EXISTS (SELECT 1 FROM b_{tag}1 s WHERE s.sh IS NOT NULL AND s.brand = p.brand AND s.entity_key = p.entity_key AND s.plc = p.plc)""")


part_blocks("pq", "1")
part_blocks("pr", "CASE WHEN rq > 0 THEN rr / rq ELSE 0 END")


def part_plan(c, metric="quantity", stats=None):
    p = c.plc.groupBy("brand", "entity_key", "plc", "month", "forecast_type").agg(F.min("route").alias("route"), F.sum("value").alias("value"))
    return HI.part_plan(c.facts, p, CUTOFF, metric, min_volume=PART_MIN, stats=stats)


@query("H5_J10_part_plan", "SELECT brand, entity_key, plc, part_number, month, route, round(share, 8) AS part_share, round(value, 5) AS value FROM b_pq")
def h5(spark, path):
    return part_plan(Center(spark, path)).select("brand", "entity_key", "plc", "part_number", "month", "route", F.round("part_share", 8).alias("part_share"), *r5("value"))


@query("H13_J15_A30_part_bundle", """SELECT q.brand, q.entity_key, q.plc, q.part_number, q.month, round(q.value, 5) AS quantity_plan, round(r.value, 5) AS revenue_plan, round(q.value * coalesce(r.unit, q.unit), 4) AS reference_revenue
FROM b_pq q LEFT JOIN b_pr r USING (brand, entity_key, plc, part_number, month)""")
def h13(spark, path):
    keys = ["brand", "entity_key", "plc", "part_number", "month"]
    c = Center(spark, path)
    stats = materialize(HI.part_stats(c.facts, CUTOFF))
    b = HI.part_bundle(part_plan(c, stats=stats), part_plan(c, "revenue", stats), keys)
    return b.select(*keys, *r5("quantity_plan", "revenue_plan"), F.round("reference_revenue", 4).alias("reference_revenue"))


@query("J16_inherited_bounds", """SELECT a.brand, a.entity_key, a.month, round(a.value, 5) AS value, round(a.value / p.value * p.value * 0.8::DOUBLE, 4) AS lower, round(a.value / p.value * p.value * 1.3::DOUBLE, 4) AS upper
FROM b_ma a JOIN b_brandfc p USING (brand, month)""")
def j16(spark, path):
    c = Center(spark, path, parts=None)
    p = c.brand.withColumns({"lower": F.col("value") * 0.8, "upper": F.col("value") * 1.3})
    return HI.inherit_bounds(c.model, p, ["brand"]).select("brand", "entity_key", "month", *r5("value"), F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


def _e7(child, parent):
    ch, pa = ", ".join(child), ", ".join(parent)
    return f"""WITH lim AS (SELECT min(o) AS s0 FROM b_hf), m AS (SELECT {ch}, o, sum(quantity) AS v FROM b_hf WHERE month <= '{CUTOFF}' GROUP BY ALL), fm AS (SELECT {ch}, min(o) AS first FROM m GROUP BY ALL),
g AS (SELECT fm.*, t.o, coalesce(m.v, 0) AS v, m.v IS NOT NULL AS present FROM fm CROSS JOIN (SELECT unnest(range((SELECT s0 FROM lim), {CO + 1})) AS o) t LEFT JOIN m ON {' AND '.join(f'm.{k} = fm.{k}' for k in child)} AND m.o = t.o),
s AS (SELECT *, sum(v) OVER (PARTITION BY {ch} ORDER BY o ROWS 5 PRECEDING) AS rec, sum(v) OVER (PARTITION BY {ch} ORDER BY o) AS his FROM g),
u AS (SELECT {', '.join('a.' + k for k in child)}, a.o AS oo, k AS horizon, a.rec, a.his, a.first <= a.o AS known, b.v AS actual, b.present FROM s a, range(1, 4) r(k), s b WHERE b.o = a.o + k AND {' AND '.join(f'a.{k} = b.{k}' for k in child)} AND a.o >= (SELECT s0 FROM lim) + 23),
p AS (SELECT *, sum(actual) OVER w AS pact, sum(rec) OVER w AS prec, sum(his) OVER w AS phis FROM u WINDOW w AS (PARTITION BY {pa}, oo, horizon)),
z AS (SELECT *, CASE WHEN prec > 0 THEN pact * CASE WHEN known THEN rec ELSE 0 END / prec WHEN phis > 0 THEN pact * CASE WHEN known THEN his ELSE 0 END / phis ELSE 0 END AS prediction, known AND (prec > 0 OR phis > 0) AS covered FROM p WHERE known OR present)
SELECT {metrics_sql('horizon,')}, count(*) FILTER (covered) AS covered_rows FROM z GROUP BY horizon"""


def e7(spark, path, child, parent):
    f = HI.allocation_folds(facts(spark, path), child, parent, CUTOFF)
    return rounded(f.groupBy("horizon").agg(*EV.metric_columns(), F.count_if("covered").alias("covered_rows")))


for _name, _c, _p in (("model", MODEL, ["brand"]), ("plc", PLC, MODEL), ("part", ["brand", "entity_key", "plc", "part_number"], ["brand", "entity_key", "plc"])):
    query(f"E7_J11_J12_W5_allocation_accuracy_{_name}", _e7(_c, _p))(lambda spark, path, c=_c, p=_p: e7(spark, path, c, p))


def _prof(scope, dims):
    alld = list(HI.LEVELS[2][1])
    sel = ", ".join(d if d in dims else f"NULL::VARCHAR AS {d}" for d in alld)
    return f"""SELECT '{scope}' AS scope, {sel}, sum(q) AS hq, sum(r) AS hr, count(*) FILTER (q > 0) AS act, count(*) AS obs, count(*) FILTER (o >= {CO - 2} AND q > 0) AS recent_positive,
 coalesce(sum(q) FILTER (o >= {CO - 5}), 0) AS rq, coalesce(sum(r) FILTER (o >= {CO - 5}), 0) AS rr, coalesce(sum(q) FILTER (o = {CO}), 0) AS lq, min(o) AS fo, min(code) AS code, {" || '::' || ".join(dims)} AS series_key
 FROM (SELECT {', '.join(dims)}, o, sum(quantity) AS q, sum(revenue) AS r, min(code) AS code FROM b_hf WHERE month <= '{CUTOFF}' GROUP BY ALL) GROUP BY {', '.join(dims)}"""


block("b_prof", "SELECT *, " + f"{CO} - fo + 1 AS hm, greatest({CO} - fo + 1 - obs, 0) AS miss, hq / greatest({CO} - fo + 1, 1) AS avgq FROM (" + " UNION ALL ".join(_prof(n, list(d)) for n, d in HI.LEVELS) + ")")


@query("A26_exception_profiles", """SELECT scope, series_key, hq AS history_quantity, act AS active_months, obs AS observed_months, recent_positive, rq AS recent6_quantity, lq AS latest_quantity,
 CAST(hm AS INT) AS history_months, miss AS missing_months, round(avgq, 6) AS monthly_average, round(CASE WHEN hq > 0 THEN hr / hq ELSE 0 END, 2) AS unit_revenue, code AS lifecycle_code FROM b_prof""")
def a26(spark, path):
    p = HI.exception_profiles(governed_facts(spark, path), CUTOFF)           # read once: columns that no profile needs are not made
    return p.select("scope", "series_key", "history_quantity", "active_months", "observed_months", "recent_positive", "recent6_quantity", "latest_quantity", "history_months",
                    "missing_months", F.round("monthly_average", 6).alias("monthly_average"), F.round("unit_revenue", 2).alias("unit_revenue"), "lifecycle_code")


alloc_blocks("pv", PLC, MODEL, "b_mv", "revenue")
_K = ", ".join(PLC)
block("b_e0", f"""SELECT {_K}, part_number, part_description, coalesce(sum(quantity) FILTER (o >= {CO - 5}), 0) AS rq, coalesce(sum(revenue) FILTER (o >= {CO - 5}), 0) AS rr,
 coalesce(sum(quantity) FILTER (month = l.last), 0) AS lq, count(DISTINCT o) FILTER (quantity > 0) AS act, sum(quantity) / greatest(1, {CO} - min(o) + 1) AS av,
 count(*) FILTER (o >= {CO - 5} OR month = l.last) AS seen, any_value(rt.route) AS route
 FROM b_hf JOIN (SELECT {_K}, max(month) AS last FROM b_hf WHERE month <= '{CUTOFF}' GROUP BY ALL) l USING ({_K}) JOIN (SELECT {_K}, min(route) AS route FROM b_pv GROUP BY ALL) rt USING ({_K})
 WHERE month <= '{CUTOFF}' GROUP BY ALL""")
block("b_e1", f"""SELECT *, CASE WHEN al > 0 THEN wl / nullif(ol, 0) ELSE wr / nullif(orr, 0) END AS sh FROM (SELECT *, sum(wl) OVER w AS al, sum(CASE WHEN ok THEN wl ELSE 0 END) OVER w AS ol,
 sum(CASE WHEN ok THEN wr ELSE 0 END) OVER w AS orr FROM (SELECT *, lq * u AS wl, rq * u AS wr, av >= {PART_MIN} AND CASE WHEN route = 'new_model_proxy' THEN rq > 0 ELSE act >= 6 END AS ok
 FROM (SELECT *, CASE WHEN rq > 0 THEN rr / rq ELSE 0 END AS u FROM b_e0 WHERE seen > 0)) WINDOW w AS (PARTITION BY {_K})) WHERE ok""")
_KEY = {n: " || '::' || ".join(d) for n, d in HI.LEVELS}


def _e8_sql(model, plc, metric):
    """From the rules: histories, planner residuals of both levels, PLCs without a part, and lost revenue."""
    given = f"""SELECT 'Model' AS scope, {_KEY['Model']} AS series_key, month, route, value FROM {model} UNION ALL SELECT 'PLC', {_KEY['PLC']}, month, route, value FROM {plc}"""
    unit = "CASE WHEN p.rq > 0 THEN p.rr / p.rq ELSE p.hr / nullif(p.hq, 0) END" if metric == "revenue" else "1"
    out = f"""WITH g AS ({given}), h AS (SELECT scope, series_key, unnest(list_filter([
 CASE WHEN code IN ('discontinued', 'inactive') THEN ('inactive_discontinued', 'high') END, CASE WHEN avgq < {PART_MIN} THEN ('low_volume', 'medium') END,
 CASE WHEN act < 6 THEN ('insufficient_active_months', 'medium') END, CASE WHEN miss > 0 THEN ('history_gaps', 'medium') END,
 CASE WHEN recent_positive = 0 AND hm >= 3 THEN ('recent_zero_streak', 'high') END, CASE WHEN code IN ('new', 'reintroduced') THEN ('new_reintroduced_proxy', 'medium') END], lambda x: x IS NOT NULL)) AS x FROM b_prof),
s AS (SELECT {', '.join('p.' + k for k in PLC)} FROM b_prof p JOIN (SELECT {_K}, min(route) AS route FROM {plc} GROUP BY ALL) r USING ({_K})
 WHERE p.scope = 'PIS_PNO' AND p.avgq >= {PART_MIN} AND p.code NOT IN ('discontinued', 'inactive') AND CASE WHEN r.route = 'new_model_proxy' THEN p.rq > 0 ELSE p.act >= 6 END
 GROUP BY ALL HAVING sum(p.lq * {unit}) > 0 OR sum(p.rq * {unit}) > 0)
SELECT scope, series_key, x[1] AS reason, x[2] AS severity, NULL::VARCHAR AS forecast_month FROM h
UNION ALL SELECT scope, series_key, 'planner_review_residual', 'high', month FROM g WHERE route = 'planner_review_residual'
UNION ALL SELECT 'PIS_PNO', {_KEY['PLC']} || '::PLANNER_REVIEW', 'planner_review_residual', 'high', month FROM {plc} p WHERE value > 0 AND NOT EXISTS (SELECT 1 FROM s WHERE {' AND '.join(f's.{k} = p.{k}' for k in PLC)})"""
    if metric != "revenue":
        return out
    return out.replace("h AS (SELECT scope", f"""v AS (SELECT scope, series_key, month, value FROM g UNION ALL SELECT 'PIS_PNO', {_KEY['PIS_PNO']}, month, value * sh FROM b_e1 JOIN {plc} USING ({_K}) WHERE sh IS NOT NULL
 UNION ALL SELECT 'PIS_PNO', {_KEY['PLC']} || '::PLANNER_REVIEW', month, value FROM {plc} p WHERE NOT EXISTS (SELECT 1 FROM b_e1 e WHERE sh IS NOT NULL AND {' AND '.join(f'e.{k} = p.{k}' for k in PLC)})),
h AS (SELECT scope""", 1) + f"""
UNION ALL SELECT DISTINCT scope, series_key, 'zero_forecast_historical_unit_price', 'medium', month FROM b_prof JOIN v USING (scope, series_key) WHERE hr > 0 AND hq > 0 AND value = 0
UNION ALL SELECT scope, series_key, 'zero_forecast_historical_unit_price', 'medium', month FROM b_prof p, (SELECT DISTINCT month FROM {model}) m WHERE hr > 0 AND hq > 0
 AND (avgq < {PART_MIN} OR act < 6 OR code IN ('discontinued', 'inactive') OR (scope = 'PIS_PNO' AND rq <= 0)) AND NOT EXISTS (SELECT 1 FROM v WHERE v.scope = p.scope AND v.series_key = p.series_key)"""


def e8(spark, path, metric):
    c = Center(spark, path, metric, "described" if metric == "revenue" else "plain")
    # every rule reads the profiles, and two of them the plan
    parts = materialize(HI.part_plan(c.facts, c.plc, CUTOFF, metric, parent=PLC, min_volume=PART_MIN).select(*HI.LEVELS[2][1], "month", "route", "value")) if metric == "revenue" else None
    profiles = materialize(HI.exception_profiles(c.facts, CUTOFF, c.levels))
    x = HI.exceptions(profiles, c.model, c.plc, parts, metric, PART_MIN)
    return x.select("scope", "series_key", "reason", "severity", "forecast_month")


@query("E8_exceptions", _e8_sql("b_ma", "b_pa", "quantity"))
def e8_quantity(spark, path):
    return e8(spark, path, "quantity")


@query("E8_revenue_exceptions", _e8_sql("b_mv", "b_pv", "revenue"))
def e8_revenue(spark, path):
    return e8(spark, path, "revenue")


@query("H12_level_labels", "SELECT brand, entity_key, model_name, part_number, min(part_description) AS part_description, sum(quantity) AS quantity FROM b_hf GROUP BY ALL HAVING count(*) > 0")
def h12(spark, path):
    return facts(spark, path).groupBy(*FO.LEVEL_KEYS["model_accessory"]).agg(F.mode("part_description", True).alias("part_description"), F.sum("quantity").alias("quantity"))


@query("A29_headline_totals", "SELECT month, 'Forecast' AS forecast_type, round(sum(value), 4) AS quantity, (SELECT round(sum(value), 4) FROM b_mv m WHERE m.month = f.month) AS allocated FROM b_brandfc f GROUP BY month")
def a29(spark, path):
    c = Center(spark, path, "revenue", None)
    a = c.brand.groupBy("month", "forecast_type").agg(F.round(F.sum("value"), 4).alias("quantity"))
    b = c.model.groupBy("month").agg(F.round(F.sum("value"), 4).alias("allocated"))
    return a.join(b, "month")


@query("H9_business_validation", f"""WITH c AS (SELECT (SELECT count(DISTINCT brand) FROM b_ma) = 3 AS anchor_set, (SELECT min(value) FROM b_ma) >= 0 AS non_negative, {_gap('b_brandfc', 'b_ma', ['brand'])} <= 0.01 AS reconciled,
 (SELECT min(month) FROM b_ma) > '{CUTOFF}' AS cutoff_before_forecast, (SELECT min(u) FROM (SELECT sum(wholesale_units) AS u FROM b_wl GROUP BY anchor_brand)) > 0 AS known_denominator)
SELECT "check", passed FROM (UNPIVOT (SELECT *, anchor_set AND non_negative AND reconciled AND cutoff_before_forecast AND known_denominator AS "all" FROM c)
 ON anchor_set, non_negative, reconciled, cutoff_before_forecast, known_denominator, "all" INTO NAME "check" VALUE passed)""")
def h9(spark, path):
    c = Center(spark, path, parts=None)
    m = c.model
    rec = HI.reconciliation(c.brand, m, ["brand"]).select(F.col("status").alias("rec_status"))
    a = m.agg(F.count_distinct("brand").alias("brands"), F.min("value").alias("lowest"), F.min("month").alias("first_month"))
    w = I.wl(spark, path).groupBy("anchor_brand").agg(F.sum("wholesale_units").alias("u")).agg(F.min("u").alias("least_units"))
    one = a.crossJoin(rec).crossJoin(w)           # three one-row tables
    return EV.check_rows(one, anchor_set=F.col("brands") == 3, non_negative=F.col("lowest") >= 0, reconciled=F.col("rec_status") == "PASS",
                         cutoff_before_forecast=F.col("first_month") > CUTOFF, known_denominator=F.col("least_units") > 0)


@query("H7_prepared_sources", """SELECT 'facts' AS source, brand, count(*) AS n, sum(quantity) AS quantity FROM b_hf GROUP BY brand
UNION ALL SELECT 'wholesale', anchor_brand, count(*), sum(wholesale_units) FROM b_wl GROUP BY anchor_brand""")
def h7(spark, path):
    f = I.facts(spark, path, model_year=True).groupBy(F.col("anchor_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))
    w = I.wl(spark, path).groupBy(F.col("anchor_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.sum("wholesale_units").alias("quantity"))
    return f.withColumn("source", F.lit("facts")).unionByName(w.withColumn("source", F.lit("wholesale")))
