"""Checks of a planning run: name conflicts, business validation, registered evidence, reconciliation roll-up."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnchorPolicy, BacktestContract
from ..functions import dates as D
from ..functions import text as T
from ..session import materialize
from . import evaluate as EV



def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node that a node reaches.

    Labels pass along edges, then jump to the label of their label, until none changes. An edge from a node to itself names a
    node without others. Null ends are left out.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null").distinct()
    both = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("component"))
    while True:
        now = materialize(now)
        heard = both.join(now.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("heard"))
        step = now.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("was"))
        jump = now.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = materialize(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "was"))
        now = step.select("node", "component")
        if not step.filter("component < was").limit(1).count():
            return now


def mapping_conflicts(wl: DataFrame) -> DataFrame:
    """(component, names, anchors, units, conflict): vehicle names that share a spelling, and the anchors that sell them.

    Names and their spellings are the two sides of a graph. A component is in conflict if two anchors have volume in it: a sale
    under one of its spellings then has no single anchor.
    """
    named = wl.filter("model_key <> ''").groupBy("model_key", "anchor_brand").agg(F.sum(T.clip_zero("wholesale_units")).alias("units"))
    edges = named.select(F.col("model_key").alias("a"), F.explode(T.model_aliases("model_key")).alias("b"))
    found = named.join(components(edges).withColumnRenamed("node", "model_key"), "model_key")
    sells = F.array_sort(F.collect_set(F.when(F.col("units") > 0, F.col("anchor_brand"))))                   # governed anchors: a fixed few
    return found.groupBy("component").agg(F.count_distinct("model_key").alias("names"), sells.alias("anchors"), F.sum("units").alias("units")).select(
        "component", "names", F.array_join("anchors", ",").alias("anchors"), "units", (F.size("anchors") > 1).alias("conflict"))


def validation(forecast: DataFrame, sales: DataFrame, wl: DataFrame, facts: DataFrame, baskets: DataFrame, reconciled: list[DataFrame],
               basket_from: str, policy: AnchorPolicy = AnchorPolicy()) -> DataFrame:
    """(check, status, measure) of seven families; an empty table gives WARN, never an error.

    anchor_set: only governed anchors are forecast (measure: anchors). shared_cutoff: sales have a latest date (dated rows).
    reconciliation: parents equal their children (rows checked). non_negative: no negative quantity (rows that have one).
    wholesale_denominator: vehicles are known (rows with any). channel_baskets: both baskets of the months from ``basket_from`` add up
    to the whole (months). model_mapping: no fact rests on a fallback anchor (rows that do).
    """
    def row(name, one: DataFrame, ok: Column, measure: Column, bad: str = "WARN"):
        return one.select(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(bad).alias("status"), measure.cast("long").alias("measure"))
    n = F.col("n")
    anchors = forecast.agg(F.count_distinct("brand").alias("n"), F.bool_and(F.col("brand").isin(*policy.anchors)).alias("governed"))
    dated = sales.agg(F.count("sale_date").alias("n"), F.count_if(F.coalesce(F.col("quantity"), F.lit(0.0)) < 0).alias("negative"))
    same = reduce(lambda a, b: a.unionByName(b), reconciled).agg(F.sum("checked").alias("n"), F.bool_and(F.col("status") == "PASS").alias("ok"))
    known = wl.agg(F.count_if(F.col("wholesale_units") > 0).alias("n"))
    split = baskets.filter(F.col("month") >= basket_from).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs("revenue_delta"), F.abs("quantity_delta"))).alias("gap"))
    fallback = facts.agg(F.count_if(F.col("anchor_method").isin(policy.prefix_method, policy.default_method)).alias("n"))
    rows = [row("anchor_set", anchors, (n > 0) & F.col("governed"), n), row("shared_cutoff", dated, n > 0, n),
            row("reconciliation", same, F.col("ok"), n, "FAIL"), row("non_negative", dated, F.col("negative") == 0, F.col("negative"), "FAIL"),
            row("wholesale_denominator", known, n > 0, n),
            split.select(F.lit("channel_baskets").alias("check"), F.when(n == 0, "WARN").when(F.col("gap") <= 1e-6, "PASS").otherwise("FAIL").alias("status"), n.alias("measure")),
            row("model_mapping", fallback, n == 0, n)]
    return reduce(lambda a, b: a.unionByName(b), rows)


def _identity(keys: DataFrame) -> DataFrame:
    """One row (fold_keys, identity) of distinct fold keys: months times horizons, a few hundred."""
    k = keys.select(*EV.FOLD).distinct().agg(F.array_sort(F.collect_list(F.struct("origin_month", "horizon", "target_month"))).alias("k"))
    text = F.transform("k", lambda x: F.concat(F.lit('{"horizon":'), x["horizon"].cast("string"), F.lit(',"originMonth":"'), x["origin_month"],
                                               F.lit('","targetMonth":"'), x["target_month"], F.lit('"}')))
    return k.select(F.size("k").cast("long").alias("fold_keys"), F.sha2(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")), 256).alias("identity"))


def observed_identity(rows: DataFrame) -> DataFrame:
    """Fold keys that rows have, as a hash."""
    return _identity(rows)


def expected_identity(span: DataFrame, contract: BacktestContract = BacktestContract()) -> DataFrame:
    """Fold keys that the contract asks for over ``span``: one row (start_ord, months)."""
    last = F.col("start_ord") + F.col("o") - 1
    o = span.select("start_ord", "months", F.explode(F.when(F.col("months") > contract.minimum_training_months,
                    F.sequence(F.lit(contract.minimum_training_months), F.col("months") - 1))).alias("o"))
    k = o.select("*", F.explode(F.array(*[F.lit(h) for h in contract.horizons])).alias("horizon")).filter(F.col("o") + F.col("horizon") <= F.col("months"))
    return _identity(k.select(D.month_from_ord(last).alias("origin_month"), D.month_from_ord(last + F.col("horizon")).alias("target_month"), "horizon"))


@dataclass(frozen=True)
class Request:
    """What a run was asked for."""

    metric: str = "quantity"
    strategy: str = "fixed_portfolio"
    cutoff: str = ""
    filtered: bool = False
    contract: str = "1"


def evidence_gate(rows: DataFrame, span: DataFrame, source: DataFrame, request: Request, registered: Request, registered_source: DataFrame,
                  entities: list[str], contract: BacktestContract = BacktestContract(), entity: str = "entity") -> DataFrame:
    """(check, passed) of a run's folds against the evidence registered for its portfolio, and the overall result ``all``.

    rows: folds of the run (origin_month, target_month, horizon, entity, actual, prediction, training_months). span: one row (start_ord, months) of its
    history. source, registered_source: one row (fingerprint) of what was learned from, then and now. A run without folds passes nothing
    that rests on them.
    """
    counts = contract.expected_counts
    per = rows.groupBy(*EV.FOLD).agg(F.count_distinct(entity).alias("n"), F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("made"),
                                     F.min("training_months").alias("least"), F.max("training_months").alias("most"))
    seen = per.agg(F.array_sort(F.collect_set("horizon")).alias("horizons"), F.min("least").alias("least"), F.max("target_month").alias("last"),
                   F.bool_and((F.col("n") == len(entities)) & (F.col("rows") == len(entities))).alias("whole"), (F.sum("made") / F.sum("rows")).alias("coverage"),
                   F.count_if(F.col("target_month") <= F.col("origin_month")).alias("leaks"), F.count(F.lit(1)).alias("folds"),
                   *[F.count_if(F.col("horizon") == h).alias(f"h{h}") for h in contract.horizons])
    names = rows.agg(F.array_sort(F.collect_set(entity)).alias("names"))                                     # governed anchors: a fixed few
    want = expected_identity(span, contract).select(F.col("fold_keys").alias("want_keys"), F.col("identity").alias("want_identity"))
    one = seen.crossJoin(names).crossJoin(_identity(rows)).crossJoin(want).crossJoin(span).crossJoin(source.select("fingerprint")).crossJoin(
        registered_source.select(F.col("fingerprint").alias("registered")))                                  # one-row tables
    formula = lambda h: F.greatest(F.lit(0), F.col("months") - contract.minimum_training_months - h + 1)
    ok = F.lit
    return EV.check_rows(
        one, full_scope=ok(not request.filtered) & (F.col("names") == F.array(*[F.lit(x) for x in sorted(entities)])), source=F.col("fingerprint") == F.col("registered"),
        target=ok(request.metric == registered.metric), strategy=ok(request.strategy == registered.strategy), cutoff=F.col("last") == registered.cutoff,
        entities=F.col("names") == F.array(*[F.lit(x) for x in sorted(entities)]), unfiltered=ok(not request.filtered), request_cutoff=ok(request.cutoff == registered.cutoff),
        contract_version=ok(request.contract == registered.contract), horizons=F.col("horizons") == F.array(*[F.lit(h) for h in sorted(contract.horizons)]),
        minimum_training=F.col("least") == contract.minimum_training_months,
        fold_counts=reduce(lambda a, b: a & b, [F.col(f"h{h}") == formula(h) for h in contract.horizons]) & (F.col("folds") > 0),
        fold_key_count=(F.col("fold_keys") == F.col("want_keys")) & (F.col("fold_keys") > 0), fold_identity=F.col("identity") == F.col("want_identity"),
        prediction_coverage=F.col("coverage") == 1.0, full_coverage=F.col("whole"), no_leak=F.col("leaks") == 0)


def rollup(reconciled: dict[str, list[DataFrame]], tolerance: float = 0.01) -> DataFrame:
    """(check, status, max_delta, tolerance, checked) for each metric, and MODEL_STATUS: FAIL if any of them fails."""
    rows = [reduce(lambda a, b: a.unionByName(b), steps).agg(F.max("max_delta").alias("max_delta"), F.sum("checked").alias("checked")).withColumn("check", F.lit(name))
            for name, steps in reconciled.items()]
    each = reduce(lambda a, b: a.unionByName(b), rows).withColumn("status", F.when(F.col("max_delta") <= tolerance, "PASS").otherwise("FAIL"))
    whole = each.agg(F.max("max_delta").alias("max_delta"), F.sum("checked").alias("checked"), F.lit("MODEL_STATUS").alias("check"),
                     F.when(F.bool_and(F.col("status") == "PASS"), "PASS").otherwise("FAIL").alias("status"))
    return each.unionByName(whole).select("check", "status", "max_delta", F.lit(tolerance).alias("tolerance"), "checked")
