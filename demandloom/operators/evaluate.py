"""Rolling-origin folds, metrics, audits, intervals and champion selection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MODEL_COMPLEXITY, BacktestContract
from ..functions import dates as D
from ..functions import forecast as FC

OUTER = ("model", "points", "actual_sum", "abs_error", "wape", "mae", "bias")
FOLD = ["origin_month", "target_month", "horizon"]


def _fold_rows(packed: DataFrame, keys: list[str], paths: Column, contract: BacktestContract) -> DataFrame:
    """Explode struct(origin length, forecast path, actual slice); the history itself is not copied."""
    horizons = list(contract.horizons)
    e = packed.select(*keys, "start_ord", F.explode(paths).alias("f"))
    e = e.select(*keys, "start_ord", "f.o", F.col("f.label").alias("backtest_model"), F.col("f.act").alias("act"),
                 F.posexplode("f.p").alias("i", "prediction"))
    e = e.filter((F.col("i") < F.size("act")) & (F.col("i") + 1).isin(*horizons))
    last = F.col("start_ord") + F.col("o") - 1
    return e.select(*keys, D.month_from_ord(last).alias("origin_month"), D.month_from_ord(last + F.col("i") + 1).alias("target_month"),
                    (F.col("i") + 1).cast("int").alias("horizon"), F.get("act", F.col("i")).alias("actual"),
                    F.greatest("prediction", F.lit(0.0)).alias("prediction"), "backtest_model",
                    F.col("o").cast("int").alias("training_months"))


def folds(packed: DataFrame, keys: list[str], model: str | Column, contract: BacktestContract = BacktestContract(),
          h: str = "h") -> DataFrame:
    """Expanding-origin folds with one method name, a column of names, or 'auto' (choice per origin)."""
    top, least = max(contract.horizons), contract.minimum_training_months

    def one(o):
        def with_history(t):
            if isinstance(model, str) and model == "auto":
                return FC.let(FC.select_best(t), lambda b: F.struct(
                    o.alias("o"), FC.path_by_name(b["train"], b["model"], top).alias("p"),
                    F.concat_ws(":", b["model"], b["preprocessing"]).alias("label"), F.slice(F.col(h), o + 1, top).alias("act")))
            p = FC.path(t, model, top) if isinstance(model, str) else FC.path_by_name(t, model, top)
            label = F.lit(model) if isinstance(model, str) else model
            return F.struct(o.alias("o"), p.alias("p"), label.alias("label"), F.slice(F.col(h), o + 1, top).alias("act"))
        return FC.let(F.slice(F.col(h), 1, o), with_history)
    paths = F.transform(F.sequence(F.lit(least), F.size(h) - 1), one)
    return _fold_rows(packed.filter(F.size(h) > least), keys, paths, contract)


def folds_working_day(packed: DataFrame, keys: list[str], contract: BacktestContract = BacktestContract(), h: str = "h") -> DataFrame:
    """Folds of the working-day-adjusted seasonal method; needs a ``days`` map (month ordinal -> days)."""
    top, least = max(contract.horizons), contract.minimum_training_months

    def one(o):
        end = F.col("start_ord") + o - 1
        ratios = F.transform(F.sequence(F.lit(1), F.lit(top)), lambda k: F.coalesce(F.try_divide(
            F.try_element_at("days", end + k), F.try_element_at("days", end + k - 12)), F.lit(1.0)))
        return F.struct(o.alias("o"), FC.working_day_seasonal(F.slice(F.col(h), 1, o), ratios).alias("p"),
                        F.lit("working_day_adjusted_seasonal").alias("label"), F.slice(F.col(h), o + 1, top).alias("act"))
    paths = F.transform(F.sequence(F.lit(least), F.size(h) - 1), one)
    return _fold_rows(packed.filter(F.size(h) > least), keys, paths, contract)


def folds_with(packed: DataFrame, keys: list[str], predictor: Callable[[list[float], int], tuple[float, str]],
               contract: BacktestContract = BacktestContract(), label: str = "custom") -> DataFrame:
    """Folds of a user-supplied predictor(history, horizon) -> (value, label).

    A failing call keeps its fold with a null prediction and the error text. Rows are
    processed where they lie (Arrow batches), so no further shuffle happens.
    """
    least, horizons = contract.minimum_training_months, contract.horizons

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = row._asdict()
                h = list(r["h"])
                for o in range(least, len(h)):
                    for k in horizons:
                        if o + k - 1 >= len(h):
                            continue
                        try:
                            value, name, err = *predictor(h[:o], k), None
                            value = max(float(value), 0.0)
                        except Exception as exc:  # noqa: BLE001 - any failure becomes a fold row
                            value, name, err = None, label, f"{type(exc).__name__}: {exc}"
                        out.append([r[c] for c in keys] + [int(r["start_ord"]) + o - 1, k, float(h[o + k - 1]), value, name, o, err])
            yield pd.DataFrame(out, columns=keys + ["last", "horizon", "actual", "prediction", "backtest_model", "training_months", "error"])

    kt = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kt}, last int, horizon int, actual double, prediction double, backtest_model string, training_months int, error string"
    raw = packed.select(*keys, "start_ord", "h").mapInPandas(run, schema)
    return raw.select(*keys, D.month_from_ord(F.col("last")).alias("origin_month"),
                      D.month_from_ord(F.col("last") + F.col("horizon")).alias("target_month"), "horizon", "actual", "prediction",
                      "backtest_model", "training_months", "error")


def metric_columns(actual="actual", prediction="prediction") -> list[Column]:
    """Forecast metrics as aggregates; rows without both numbers count only as rows."""
    a, p = F.col(actual), F.col(prediction)
    ok = a.isNotNull() & p.isNotNull()
    err = F.when(ok, p - a)
    den = F.nullif(F.sum(F.when(ok, F.abs(a))), F.lit(0.0))
    wape = F.sum(F.abs(err)) / den
    n, rows = F.count_if(ok), F.count(F.lit(1))
    return [wape.alias("wape"),
            F.when(wape.isNotNull(), F.greatest(F.lit(0.0), 1 - wape)).alias("accuracy"),
            F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("signed_bias"), (F.sum(err) / den).alias("bias_pct"),
            F.stddev_pop(F.when(ok & (a != 0), F.abs(err) / F.abs(a))).alias("fold_std"),
            (n / rows).alias("coverage"), n.alias("fold_count"), rows.alias("row_count"),
            F.coalesce(F.sum(F.when(ok, a)), F.lit(0.0)).alias("actual_total"),
            F.coalesce(F.sum(F.when(ok, p)), F.lit(0.0)).alias("prediction_total")]


def summarize(df: DataFrame, groups: list[str] | None = None, sets: list[list[str]] | None = None) -> DataFrame:
    if sets:
        return df.groupingSets([tuple(s) for s in sets], *groups).agg(*metric_columns())
    return df.groupBy(*groups).agg(*metric_columns()) if groups else df.agg(*metric_columns())


def common_folds(rows: DataFrame, entities: int, entity: str = "entity") -> DataFrame:
    """Rows of the folds that every entity has."""
    n = rows.groupBy(*FOLD).agg(F.count_distinct(entity).alias("n")).filter(F.col("n") == entities)
    return rows.join(n.select(*FOLD), FOLD, "left_semi")


def portfolio_total(rows: DataFrame, entities: int, entity: str = "entity") -> DataFrame:
    """Sum of all entities per common fold; the total is null when any prediction is missing."""
    c = common_folds(rows, entities, entity)
    return c.groupBy(*FOLD).agg(F.sum("actual").alias("actual"),
                                F.when(F.count("prediction") == entities, F.sum("prediction")).alias("prediction"))


def audit(rows: DataFrame, expected: dict[str, int], entities: list[str], entity: str = "entity") -> DataFrame:
    """One row: duplicates, fold counts against the formula, entity sets, missing predictions, status."""
    per_key = rows.groupBy(*FOLD, entity).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isNull()).alias("missing"))
    per_fold = per_key.groupBy(*FOLD).agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dups"), F.sum("missing").alias("missing"), F.sum("n").alias("rows"),
        F.count_if(F.col(entity).isin(*entities)).alias("known"), F.count(F.lit(1)).alias("seen"))
    hs = [h for h in expected if h != "combined"]
    agg = per_fold.agg(
        F.sum("dups").alias("duplicate_rows"), F.sum("missing").alias("missing_predictions"), F.sum("rows").alias("n"),
        F.count_if((F.col("known") != len(entities)) | (F.col("seen") != len(entities))).alias("entity_mismatches"),
        *[F.count_if(F.col("horizon") == int(h)).alias(f"h{h}") for h in hs], F.count(F.lit(1)).alias("combined"))
    count_bad = reduce(lambda a, b: a | b, [F.col(f"h{h}") != expected[h] for h in hs]) | (F.col("combined") != expected["combined"])
    ok = (F.col("duplicate_rows") == 0) & (F.col("missing_predictions") == 0) & (F.col("entity_mismatches") == 0) & ~count_bad
    return agg.select("duplicate_rows", "missing_predictions", "entity_mismatches", *[f"h{h}" for h in hs], "combined",
                      count_bad.alias("count_mismatch"), ((F.col("n") - F.col("missing_predictions")) / F.col("n")).alias("coverage"),
                      F.when(ok, "pass").otherwise("fail").alias("status"))


def higher_quantile(sorted_values: Column, q: float) -> Column:
    """Order statistic at the higher of the two ranks around q."""
    return F.get(sorted_values, F.ceil((F.size(sorted_values) - 1) * F.lit(q)).cast("int"))


def intervals(points: DataFrame, residuals: DataFrame, keys: list[str], *, coverage: float = 0.90, minimum: int = 5) -> DataFrame:
    """Bounds from past held-out residuals of the same horizon, with prequential coverage.

    Residuals are gathered per (series, horizon): one entry per fold of one series.
    """
    r = (residuals.filter("actual is not null and prediction is not null")
         .groupBy(*keys, "horizon").agg(F.array_sort(F.collect_list(F.struct(
             "target_month", "origin_month", F.abs(F.col("actual") - F.col("prediction")).alias("r")))).alias("rs")))
    j = points.join(r, keys + ["horizon"], "left")
    past = F.filter(F.coalesce("rs", F.array().cast(r.schema["rs"].dataType)), lambda x: x["target_month"] < F.col("month"))
    j = j.withColumn("past", F.transform(past, lambda x: x["r"])).drop("rs")
    n, point = F.size("past"), F.greatest(F.col("point"), F.lit(0.0))
    radius = F.coalesce(higher_quantile(F.array_sort("past"), coverage), F.lit(0.0))
    hits = F.transform("past", lambda x, i: F.when(i >= minimum, F.when(
        x <= higher_quantile(F.array_sort(F.slice("past", 1, i)), coverage), 1).otherwise(0)))
    samples = F.greatest(n - minimum, F.lit(0))
    return j.withColumn("radius", radius).withColumn("hits", F.aggregate(F.filter(hits, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)).select(
        *keys, "horizon", "month", point.alias("point"), F.greatest(F.lit(0.0), point - F.col("radius")).alias("lower"),
        (point + F.col("radius")).alias("upper"), F.when(samples > 0, F.col("hits") / samples).alias("empirical_coverage"),
        samples.alias("coverage_samples"), n.alias("residual_count"),
        F.when(n >= minimum, "validated").otherwise("unvalidated_insufficient_residuals").alias("status"))


def champion(metrics: DataFrame, name: str = "model", tie_band: float = 0.005, groups: list[str] | None = None) -> DataFrame:
    """Within ``tie_band`` of the lowest WAPE: |bias|, stability, coverage, complexity, name."""
    g = groups or []
    ok = metrics.filter("wape is not null and fold_count > 0")
    low = ok.groupBy(*g).agg(F.min("wape").alias("minimum_wape"))
    tied = (ok.join(low, g) if g else ok.crossJoin(F.broadcast(low))).filter(F.col("wape") <= F.col("minimum_wape") + tie_band)
    cx = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MODEL_COMPLEXITY.items() for x in kv]), F.col(name)), F.lit(99))
    inf = F.lit(float("inf"))
    rank = F.struct(F.coalesce(F.abs("bias_pct"), inf), F.coalesce("fold_std", inf), -F.coalesce("coverage", F.lit(0.0)), cx, F.col(name))
    return tied.groupBy(*g).agg(F.min_by(name, rank).alias("champion"), F.count(F.lit(1)).alias("tie_count"),
                                F.array_join(F.array_sort(F.collect_set(name)), ",").alias("tie_set"), F.min("minimum_wape").alias("minimum_wape"))


def leaderboard(metrics: DataFrame, name: str = "model") -> DataFrame:
    """Rank of every method by WAPE (one row per method)."""
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(F.col("wape").asc_nulls_last(), F.abs("bias_pct"), name)))


def nowcast_backtest(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Blend of the forecast made before the month and the month-to-date projection, per cutoff day."""
    j = rows.join(F.broadcast(weights), "cutoff_day")         # one row per cutoff day
    p = j.withColumn("prediction", (1 - F.col("weight")) * F.col("premonth") + F.col("weight") * F.col("mtd_projection"))
    return p.groupingSets([("cutoff_day",), ()], "cutoff_day").agg(*metric_columns())


def with_outer_test(packed: DataFrame, use_seasonality: bool = True) -> DataFrame:
    """Add struct ``ev``: choose on the first n - holdout months, then score expanding one-step
    forecasts on the rest. Null when fewer than three months remain for the choice."""
    n = F.size("h")
    split = n - F.least(F.lit(6), F.greatest(F.lit(3), F.floor(n / 4).cast("int")))
    p = FC.once(packed.withColumn("split", split), "hp", F.when(F.col("split") >= 3, F.slice("h", 1, F.col("split"))))
    p = FC.with_best(p, "hp", "eb", use_seasonality)
    # softening only looks back, so prefixes of the softened full history serve every origin
    p = FC.once(p, "et", F.when(F.col("eb_preprocessing") == "cleaned", FC.soften(F.col("h"))["v"]).otherwise(F.col("h")))
    preds = FC.memo(("outer",), lambda: F.transform(F.sequence(F.col("split"), F.size("h") - 1), lambda i: FC.let(
        F.slice("et", 1, i), lambda t: F.greatest(F.lit(0.0), F.get(FC.path_by_name(t, F.col("eb_model"), 1), 0)))))
    p = FC.once(p, "ep", F.when(F.col("eb_model").isNotNull(), preds))
    return FC.once(p, "ev", F.when(F.col("ep").isNotNull(), outer_scores(F.col("eb_model"), F.col("ep"), F.slice("h", F.col("split") + 1, F.size("h")))), OUTER)


def outer_scores(model: Column, pred: Column, act: Column) -> Column:
    err = FC.asum(F.zip_with(pred, act, lambda a, b: F.abs(a - b)))
    tot = FC.asum(act)
    return F.struct(model.alias("model"), F.size(act).alias("points"), tot.alias("actual_sum"), err.alias("abs_error"),
                    F.when(tot > 0, err / tot).alias("wape"), (err / F.size(act)).alias("mae"),
                    F.when(tot > 0, (FC.asum(pred) - tot) / tot).alias("bias"))


def outer_test(packed: DataFrame, keys: list[str], use_seasonality: bool = True) -> DataFrame:
    p = with_outer_test(packed, use_seasonality).filter("ev_model is not null")
    return p.select(*keys, "split", F.col("ev_model").alias("backtest_model"), *[F.col(f"ev_{c}").alias(c) for c in OUTER[1:]])


def evaluation_scopes(rows: DataFrame, entities: list[str], entity: str = "entity") -> DataFrame:
    """Row counts and metrics of entity-level rows and of the summed rows of complete folds."""
    per = summarize(rows).withColumn("scope", F.lit("entity_rows"))
    tot = summarize(portfolio_total(rows, len(entities), entity)).withColumn("scope", F.lit("common_origin_total"))
    return per.unionByName(tot)


def checks(**conditions: Column) -> list[Column]:
    """Named boolean checks as array entries for ``check_rows``."""
    return [F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in conditions.items()]


def check_rows(one_row: DataFrame, **conditions: Column) -> DataFrame:
    """Turn a one-row summary into (check, passed) rows plus the overall result."""
    e = one_row.select(F.explode(F.array(*checks(**conditions))).alias("c")).select("c.*")
    total = e.agg(F.lit("all").alias("check"), F.bool_and("passed").alias("passed"))
    return e.unionByName(total)
