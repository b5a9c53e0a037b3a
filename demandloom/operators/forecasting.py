"""Forecast composition: strategies, hierarchical forecasts, part portfolio, alerts, nowcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import REGIME_PRIORITY
from ..functions import dates as D
from ..functions import forecast as FC
from ..functions import kernel as K
from ..functions import text as T
from . import evaluate as EV
from . import explore as X
from . import moments as M
from . import series as S


# --- working days along a series ----------------------------------------------------

def calendar_row(cal: DataFrame) -> DataFrame:
    """One row: month -> days, month-of-year -> mean days, overall mean. Size is that of a calendar."""
    moy = cal.groupBy(F.substring("month", 6, 2).cast("int").alias("m")).agg(F.avg("working_days").alias("d"))
    return (cal.agg(F.map_from_entries(F.collect_list(F.struct(D.month_ord(F.col("month")), "working_days"))).alias("days"),
                    F.avg("working_days").alias("mean_days"))
            .crossJoin(moy.agg(F.map_from_entries(F.collect_list(F.struct("m", "d"))).alias("moy"))))


def with_days(packed: DataFrame, cal: DataFrame, horizon: int) -> DataFrame:
    """Add ``day_list`` (one entry per history and forecast month) and ``mean_days``.

    An unknown month takes the mean of its calendar month, else the overall mean.
    """
    pos = F.sequence(F.lit(0), F.col("n") + F.lit(horizon - 1))
    val = lambda o: F.coalesce(F.try_element_at("days", o), F.try_element_at("moy", (o % 12 + 1).cast("int")), F.col("mean_days"))
    return (packed.crossJoin(F.broadcast(calendar_row(cal)))
            .withColumn("day_list", F.transform(pos, lambda i: val(F.col("start_ord") + i))))


# --- driver regression ---------------------------------------------------------------

DRIVER = "forecast array<double>, wape double, mae double, bias double, coef array<double>, split_wape double, outer_pred array<double>"


def _inner_scores(h: Column, p: Column, n: Column) -> Column:
    """struct(wape, mae, bias) of the one-step predictions of the last quarter (three to six months) of the first ``n`` months."""
    k = F.least(F.lit(6), F.greatest(F.lit(3), F.floor(n / 4).cast("int")))

    def score(pair):
        err, tot = FC.asum(F.zip_with(pair["p"], pair["a"], lambda x, y: F.abs(x - y))), FC.asum(pair["a"])
        return F.struct(F.when(tot != 0, err / tot).alias("wape"), (err / F.size(pair["a"])).alias("mae"), F.when(tot != 0, (FC.asum(pair["p"]) - tot) / tot).alias("bias"))
    return F.when(n >= 18, FC.let(F.struct(F.slice(p, n - k - 11, k).alias("p"), F.slice(h, n - k + 1, k).alias("a")), score))


def driver_forecast(packed: DataFrame, cal: DataFrame, horizon: int, use_working_days: bool = True, use_seasonality: bool = True) -> DataFrame:
    """Add DRIVER columns: least squares on intercept, trend, centred working days and one yearly harmonic; needs 18 months.

    Series become rows of months; running moments give every month the regression over the months before it, so one pass serves the
    inner test, the outer test and the forecast. Equal series are solved once.
    """
    key = F.md5(F.to_json(F.struct("start_ord", "h")))
    d = with_days(packed, cal, horizon).withColumn("__series", key)
    if not (use_working_days or use_seasonality):
        return d.withColumns({f"driver_{a}": F.lit(None).cast(t) for a, t in (x.split() for x in DRIVER.split(", "))}).drop("__series")
    once = d.filter(F.size("h") >= 18).select("__series", "start_ord", "h", "day_list", "mean_days").dropDuplicates(["__series"])
    rows = once.select("__series", "start_ord", F.size("h").alias("n"), "mean_days", "h", F.posexplode("day_list").alias("t", "day")).select(
        "__series", "start_ord", "n", "mean_days", F.col("t").cast("double").alias("t"), "day", F.get("h", F.col("t")).alias("y"))
    angle = (F.lit(2 * np.pi) * ((F.col("start_ord") + F.col("t")) % 12 + 1)) / 12
    x = [F.lit(1.0), F.col("t")]
    if use_working_days:
        x.append((F.col("day") - F.col("mean_days")) / F.greatest("mean_days", F.lit(1.0)))
    if use_seasonality:
        x += [F.sin(angle), F.cos(angle)]
    rows = rows.withColumns({f"x_{i}": c for i, c in enumerate(x)})
    x = [F.col(f"x_{i}") for i in range(len(x))]
    before = Window.partitionBy("__series").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    fit = M.solved(M.with_moments(rows, x, F.col("y"), F.col("t") < F.col("n"), before), len(x))
    fit = fit.filter("t >= 12").withColumn("p", F.greatest(M.dot(x), F.lit(0.0)))
    weights = F.array(*[F.round(f"w_{i}", 6) for i in range(len(x))])
    per = fit.groupBy("__series").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "p"))), lambda r: r["p"]).alias("__p"),
                                      F.max_by(F.when(F.col("t") == F.col("n"), weights), F.when(F.col("t") == F.col("n"), F.lit(1))).alias("driver_coef"))
    j = d.join(per, "__series", "left")
    n, p, h = F.size("h"), F.col("__p"), F.col("h")
    hold = F.least(F.lit(6), F.greatest(F.lit(3), F.floor(n / 4).cast("int")))
    j = FC.once(j, "__in", F.when(p.isNotNull(), _inner_scores(h, p, n)))
    return j.withColumns({
        "driver_forecast": F.slice(p, n - 11, horizon), "driver_wape": F.col("__in.wape"), "driver_mae": F.col("__in.mae"), "driver_bias": F.col("__in.bias"),
        "driver_split_wape": F.when(p.isNotNull(), _inner_scores(h, p, n - hold)["wape"]), "driver_outer_pred": F.slice(p, n - hold - 11, hold)}).drop("__in", "__p", "__series")


def coefficient_rows(df: DataFrame, keys: list[str], use_working_days: bool = True, use_seasonality: bool = True) -> DataFrame:
    """Named coefficients with the per-day effect and the seasonal amplitude."""
    names = ["intercept", "trend_per_month"] + (["working_days_ratio"] if use_working_days else []) + (["season_sin", "season_cos"] if use_seasonality else [])
    c = {n: F.get("driver_coef", i) for i, n in enumerate(names)}
    if use_working_days:
        c["working_day_effect"] = F.round(c["working_days_ratio"] / F.greatest("mean_days", F.lit(1.0)), 6)
    if use_seasonality:
        c["seasonal_amplitude"] = F.round(F.hypot(c["season_sin"], c["season_cos"]), 6)
    e = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in c.items()])
    return df.filter("driver_coef is not null").select(*keys, F.explode(e).alias("c")).select(*keys, "c.*")


# --- strategy choice -------------------------------------------------------------------

GOVERNED = ("reference_portfolio", "tree_meta_selector_v1", "elastic_net_anchor_residual_v1")

def resolve(packed: DataFrame, cal: DataFrame, *, strategy: str = "auto", horizon: int = 6, use_working_days: bool = True,
            use_seasonality: bool = True, evaluate: bool = True, stored: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add model, preprocessing, forecast, wape, note (and the independent outer test ``ev``) per series.

    strategy: 'auto' (baselines against driver regression), 'baseline_auto',
    'driver_adjusted_regression', or one baseline method by name. 'reference_portfolio' and the learned
    challengers (with their ``stored`` models and the ``source`` at hand) work on series keyed by ``entity``;
    their tests are fold rows of ``challengers``, so ``ev`` and wape are not added.
    """
    if strategy in GOVERNED:
        from . import challengers            # builds on this module
        f = challengers.strategy(packed, cal, strategy, horizon, stored, source)
        return packed.join(f.select("entity", F.col("model").alias("pick_model"), F.lit("raw").alias("pick_preprocessing"), F.col("forecast").alias("pick_forecast")), "entity").withColumns(
            {"pick_wape": F.lit(None).cast("double"), "note": F.lit("governed")})
    if strategy not in ("auto", "baseline_auto", "driver_adjusted_regression") and strategy != "ets_additive" and strategy not in FC._NEXT:
        raise ValueError(f"unknown strategy {strategy!r}")
    h = F.col("h")
    p = driver_forecast(packed, cal, horizon, use_working_days, use_seasonality) if strategy in ("auto", "driver_adjusted_regression") else \
        packed.withColumns({f"driver_{a}": F.lit(None).cast(t) for a, t in (x.split() for x in DRIVER.split(", "))})
    p = FC.with_path(FC.with_best(p, "h", "b", use_seasonality), "b_train", "b_model", horizon, "base_path")
    p = EV.with_outer_test(p, use_seasonality) if evaluate else p
    base = F.struct(F.col("b_model").alias("model"), F.col("b_preprocessing").alias("preprocessing"),
                    F.col("base_path").alias("forecast"), F.col("b_wape").alias("wape"))
    drv = F.struct(F.lit("driver_adjusted_regression").alias("model"), F.lit("raw").alias("preprocessing"),
                   F.col("driver_forecast").alias("forecast"), F.col("driver_wape").alias("wape"))
    has, d_ev = F.col("driver_forecast").isNotNull(), F.slice("h", F.size("h") - F.size("driver_outer_pred") + 1, F.size("driver_outer_pred"))
    if strategy == "baseline_auto":
        pick, note, drv_outer = base, F.lit("baseline"), F.lit(False)
    elif strategy == "driver_adjusted_regression":
        pick, note = F.when(has, drv).otherwise(base), F.when(has, "forced").otherwise("fallback")
        drv_outer = F.col("split") >= 18 if evaluate else F.lit(False)
    elif strategy == "auto":
        better = has & (F.col("b_wape").isNull() | F.coalesce(F.col("driver_wape") < F.col("b_wape"), F.lit(False)))
        pick, note = F.when(better, drv).otherwise(base), F.when(better, "driver").otherwise("baseline")
        drv_outer = (F.col("driver_split_wape").isNotNull() & (F.col("eb_wape").isNull() | F.coalesce(
            F.col("driver_split_wape") < F.col("eb_wape"), F.lit(False)))) if evaluate else F.lit(False)
    else:
        fits = F.array_contains(FC.candidates(h, use_seasonality), strategy)
        forced = F.struct(F.lit(strategy).alias("model"), F.lit("raw").alias("preprocessing"), FC.path(h, strategy, horizon).alias("forecast"),
                          FC.backtest_errors(h, h, strategy)["wape"].alias("wape"))
        pick, note, drv_outer = F.when(fits, forced).otherwise(base), F.when(fits, "forced").otherwise("fallback"), F.lit(False)
        if evaluate:
            n = F.size("h")
            forced_pred = F.transform(F.sequence(F.col("split"), n - 1), lambda i: FC.let(F.slice("h", 1, i), lambda t: F.get(FC.path(t, strategy, 1), 0)))
            ok = F.array_contains(FC.candidates(F.slice("h", 1, F.greatest(F.col("split"), F.lit(1))), use_seasonality), strategy) & (F.col("split") >= 3)
            p = _override(p, ok, EV.outer_scores(F.lit(strategy), forced_pred, F.slice("h", F.col("split") + 1, n)))
    if evaluate and strategy in ("auto", "driver_adjusted_regression"):
        p = _override(p, drv_outer, EV.outer_scores(F.lit("driver_adjusted_regression"), F.col("driver_outer_pred"), d_ev))
    return FC.once(p, "pick", pick, ("model", "preprocessing", "forecast", "wape")).withColumn("note", note)


def _override(df: DataFrame, when: Column, scores: Column) -> DataFrame:
    """Replace the outer-test columns where the condition holds."""
    df = FC.once(df, "alt", F.when(when, scores), EV.OUTER)
    return df.withColumns({f"ev_{c}": F.when(F.col("alt_model").isNotNull(), F.col(f"alt_{c}")).otherwise(F.col(f"ev_{c}"))
                           for c in EV.OUTER}).drop(*[f"alt_{c}" for c in EV.OUTER])


LEVEL_KEYS = {"brand": ["brand"], "model": ["brand", "entity_key", "model_name"],
              "model_accessory": ["brand", "entity_key", "model_name", "part_number"]}


def hierarchical(facts: DataFrame, cal: DataFrame, level: str, *, horizon: int = 6, strategy: str = "auto", value: str = "quantity",
                 use_working_days: bool = True, use_seasonality: bool = True, tariff_pct: float = 0.0, min_volume: float = 5.0,
                 limit: int | None = None, latest_complete: bool = False, check_volume: bool = True) -> DataFrame:
    """One row per eligible series with its forecast, choice and outer test.

    ``limit`` keeps the largest series (a report size); the default forecasts all of them.
    """
    if level not in LEVEL_KEYS:
        raise ValueError(f"Unsupported forecast level: {level}")
    if level == "model_accessory" and strategy != "auto":
        raise ValueError("part-level forecasting always chooses the method per series")
    keys = LEVEL_KEYS[level]
    f = facts.withColumn("v", F.greatest(F.col(value).cast("double"), F.lit(0.0)))
    comp = X.volume_completeness(facts.withColumn("quantity", F.greatest(F.col(value).cast("double"), F.lit(0.0))))
    full = F.lit(latest_complete) & (F.col("supports_complete") if check_volume else F.lit(True))
    cutoff = comp.select(F.when(full, F.col("latest_month")).otherwise(
        D.month_from_ord(D.month_ord(F.col("latest_month")) - 1)).alias("cutoff"))
    f = f.crossJoin(F.broadcast(cutoff)).filter(F.col("month") <= F.col("cutoff"))      # one row
    packed = S.pack(f, keys + ["cutoff"], F.col("v"), end=F.col("cutoff"))
    life = "lifecycle_status" in facts.columns
    meta = f.groupBy(*keys).agg((T.single_or_mixed(F.col("lifecycle_status")) if life else F.lit("Unknown")).alias("lifecycle_status"),
                                *([T.mode_text("part_description").alias("part_description")] if level == "model_accessory" else []))
    packed = packed.withColumns({"history_volume": FC.asum(F.col("h")), "active_months": F.size(F.filter("h", lambda x: x > 0))})
    packed = packed.withColumn("monthly_average", F.col("history_volume") / F.greatest(F.col("n"), F.lit(1)))
    ok = packed.filter((F.col("monthly_average") >= min_volume) & (F.col("active_months") >= 6))
    if limit:
        top = ok.orderBy(F.desc("history_volume"), *keys).limit(limit).select(*keys)
        ok = ok.join(top, keys, "left_semi")
    r = resolve(ok, cal, strategy=strategy, horizon=horizon, use_working_days=use_working_days, use_seasonality=use_seasonality)
    r = r.join(meta, keys)
    gone = F.col("lifecycle_status").startswith("Discontinued through") if level != "brand" else F.lit(False)
    mult = max(0.0, 1.0 + tariff_pct / 100.0)
    out = F.when(gone, F.array_repeat(F.lit(0.0), horizon)).otherwise(F.transform("pick_forecast", lambda v: F.greatest(F.lit(0.0), v * mult)))
    return r.select(*keys, F.lit(level).alias("level"), *(["part_description"] if level == "model_accessory" else []), "lifecycle_status", "cutoff",
                    "start_ord", F.col("n").alias("history_months"), "active_months", "history_volume", "monthly_average",
                    F.element_at("h", -1).alias("latest_actual"), F.when(gone, "discontinued_zero").otherwise(F.col("pick_model")).alias("selected_model"),
                    F.col("pick_preprocessing").alias("preprocessing"), "note", F.col("ev_model").alias("backtest_model"),
                    *[F.col(f"ev_{c}").alias(c) for c in ("points", "actual_sum", "abs_error", "wape", "mae", "bias")], out.alias("forecast"))


def forecast_long(records: DataFrame, keys: list[str]) -> DataFrame:
    """(series, month, value) rows of the forecast arrays."""
    e = records.select(*keys, "start_ord", F.col("history_months").alias("n"), F.posexplode("forecast").alias("i", "value"))
    return e.select(*keys, D.month_from_ord(F.col("start_ord") + F.col("n") + F.col("i")).alias("month"), (F.col("i") + 1).alias("horizon"), "value")


def hierarchical_summary(records: DataFrame) -> DataFrame:
    """Series per chosen method and the volume-weighted outer WAPE (null method = all)."""
    return (records.groupingSets([("selected_model",), ()], "selected_model").agg(
        F.count(F.lit(1)).alias("series"), (F.sum("abs_error") / F.nullif(F.sum("actual_sum"), F.lit(0.0))).alias("weighted_wape"))
        .withColumn("accuracy_pct", F.round(F.greatest(F.lit(0.0), 1 - F.col("weighted_wape")) * 100, 2)))


# --- part portfolio, watch list, alerts ---------------------------------------------------

def rate(packed: DataFrame, residual_pct: Column | None = None) -> DataFrame:
    """Selection, next value, shape, anomalies, confidence, risk, tier and score per series."""
    h = F.col("h")
    d = FC.with_path(FC.with_best(packed.filter("n > 3")), "b_train", "b_model", 1, "one_step")
    d = FC.once(d, "r", FC.regime(h), ("code", "label", "severity", "change_pct", "shift_pct", "volatility"))
    d = FC.once(d.select("*", K.anomalies_of(h, 4).alias("anomalies")), "confidence", FC.confidence(h, F.col("b_wape"), F.col("b_bias")))
    d = d.withColumns({"next_forecast": F.get("one_step", 0), "latest": F.element_at(h, -1)})
    d = d.withColumn("risk", FC.risk(F.col("confidence"), F.col("b_wape"), F.col("b_bias"), F.col("r_code"), F.size("anomalies"), residual_pct))
    return d.withColumns({
        "tier": FC.tier(F.col("n"), F.col("risk"), F.col("r_code"), F.col("b_wape"), F.col("b_bias"), F.col("r_volatility")),
        "score": FC.reliability(F.col("n"), F.col("b_wape"), F.col("b_bias"), F.col("confidence"), F.col("r_code"), F.col("risk"))})


def top_parts(sales: DataFrame, k: int) -> DataFrame:
    return (sales.filter("sale_date is not null").groupBy("part_number").agg(F.sum("quantity").alias("total_quantity"))
            .orderBy(F.desc("total_quantity"), "part_number").limit(k))


def part_series(sales: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    s = sales if parts is None else sales.join(F.broadcast(parts.select("part_number")), "part_number", "left_semi")
    s = X.drop_partial_part_months(s).withColumn("month", D.month_of("sale_date"))
    return S.pack(s, ["part_number"], F.col("quantity"))


def portfolio(sales: DataFrame, scan: int | None = None) -> DataFrame:
    """Rated parts with their share of the volume: every part, or the ``scan`` largest."""
    parts = top_parts(sales, scan) if scan else sales.groupBy("part_number").agg(F.sum("quantity").alias("total_quantity"))
    tot = parts.agg(F.sum("total_quantity").alias("scan_total"))
    d = rate(part_series(sales, parts if scan else None)).join(parts, "part_number").crossJoin(F.broadcast(tot))
    prio = F.when(F.col("tier") == "planner_ready", 1).when(F.col("tier") == "needs_review", 2).otherwise(3)
    return d.select("part_number", "n", "latest", "next_forecast", FC.pct(F.col("next_forecast") - F.col("latest"), F.col("latest")).alias("delta_pct"),
                    "confidence", "risk", F.col("r_code").alias("regime"), F.col("b_wape").alias("wape"), F.col("b_bias").alias("bias"),
                    F.col("b_model").alias("model"), F.col("b_preprocessing").alias("preprocessing"), "tier", prio.alias("priority"), "score",
                    "total_quantity", (F.col("total_quantity") / F.nullif(F.col("scan_total"), F.lit(0.0))).alias("quantity_share"))


def portfolio_summary(records: DataFrame) -> DataFrame:
    order = F.struct(F.col("priority"), -F.col("score"), -F.col("total_quantity"), F.col("part_number"))
    pick = F.least(F.lit(3), F.col("priority"))
    is_ = lambda t: F.count_if(F.col("tier") == t)
    return records.agg(F.count(F.lit(1)).alias("scanned"), is_("planner_ready").alias("ready"), is_("needs_review").alias("review"),
                       is_("do_not_auto_plan").alias("stopped"),
                       F.coalesce(F.sum(F.when(F.col("tier") == "planner_ready", F.col("quantity_share"))), F.lit(0.0)).alias("ready_share"),
                       F.min_by("part_number", F.struct(pick, order)).alias("recommended_part"))


def watchlist(sales: DataFrame, scan: int | None = None, limit: int = 8) -> DataFrame:
    """The ``limit`` parts whose forecast moves most, of every part or of the ``scan`` largest."""
    d = rate(part_series(sales, top_parts(sales, scan) if scan else None))
    d = d.select("part_number", "latest", "next_forecast", FC.pct(F.col("next_forecast") - F.col("latest"), F.col("latest")).alias("delta_pct"), "confidence")
    return d.orderBy(F.desc(F.coalesce(F.abs("delta_pct"), F.lit(0.0))), F.desc("next_forecast"), "part_number").limit(limit)


def explain_changes(sales: DataFrame, key: str, dims: list[str], top: int = 5) -> DataFrame:
    """Latest against previous active month per key, split by each dimension; largest moves first."""
    last = sales.groupBy(key).agg(F.max("sale_date").alias("__last"))
    partial = (F.col("__last") < F.last_day("__last")) & (F.dayofmonth("__last") <= 27) & (F.trunc("sale_date", "month") == F.trunc("__last", "month"))
    s = sales.join(last, key).filter(~partial).withColumn("month", D.month_of("sale_date"))
    e = s.select(key, "month", "quantity", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("name")) for d in dims])).alias("x"))
    g = e.groupBy(key, "month", "x.dimension", "x.name").agg(F.sum("quantity").alias("q"))
    months = g.groupBy(key).agg(F.slice(F.sort_array(F.collect_set("month"), False), 1, 2).alias("m")).filter(F.size("m") >= 2)
    d = (g.join(months, key).filter(F.col("name").isNotNull()).groupBy(key, "dimension", "name").agg(
        F.coalesce(F.sum(F.when(F.col("month") == F.get("m", 0), F.col("q"))), F.lit(0.0)).alias("latest"),
        F.coalesce(F.sum(F.when(F.col("month") == F.get("m", 1), F.col("q"))), F.lit(0.0)).alias("previous")))
    d = d.withColumn("delta", F.col("latest") - F.col("previous")).filter("delta <> 0")
    w = Window.partitionBy(key, "dimension").orderBy(F.desc(F.abs("delta")), "name")
    return d.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)


def exposure_fits(features: DataFrame) -> DataFrame:
    """Per part and month: the quantity that a ridge regression over the months before expects, and the part of it that is due to an
    unusual vehicle exposure. Running moments give every month its own fit; the intercept is not shrunk."""
    x = [F.lit(1.0), *[F.col(c) for c in ("lag1", "lag2", "rolling3", "exposure", "exposure_change", "time_idx")]]
    before = Window.partitionBy("part_number").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("actual").isNotNull()
    for c in x[1:]:
        good = good & c.isNotNull()
    f = features.withColumn("good", good)
    f = M.with_moments(f, x, F.col("actual"), F.col("good"), before).withColumn("usual", F.col("a_0_4") / F.col("rows"))
    f = M.solved(f.filter("good and time_idx >= 5 and rows >= 5"), len(x), [0.0] + [1.0] * 6)
    return f.select("part_number", "month", "actual", "exposure", F.greatest(M.dot(x), F.lit(0.0)).alias("expected"),
                    (F.col("w_4") * (F.col("exposure") - F.col("usual")) + F.col("w_5") * F.col("exposure_change")).alias("contribution"))


def exposure_model(features: DataFrame) -> DataFrame:
    """The fit of each part's latest month, its residual, and how well the fits of all its months did."""
    last = features.groupBy("part_number").agg(F.max("month").alias("latest_month"))
    w = Window.partitionBy("part_number").orderBy("month")
    shown = features.select("part_number", "month", F.lag("exposure").over(w).alias("previous"))
    own = exposure_fits(features).groupBy("part_number").agg(
        F.sum(F.abs(F.col("expected") - F.col("actual"))).alias("err"), F.sum("actual").alias("tot"),
        F.max_by(F.struct("month", "actual", "exposure", "expected", "contribution"), "month").alias("l"))
    d = own.join(last, "part_number").filter("l.month = latest_month").join(shown.withColumnRenamed("month", "latest_month"), ["part_number", "latest_month"])
    d = d.withColumn("wape", F.when(F.col("tot") != 0, F.col("err") / F.col("tot")))
    strength = F.when(F.col("wape").isNull(), "Unavailable").when(F.col("wape") <= 0.2, "Strong").when(F.col("wape") <= 0.4, "Moderate").otherwise("Weak")
    return d.select("part_number", F.col("l.exposure").alias("latest_exposure"), FC.pct(F.col("l.exposure") - F.col("previous"), F.col("previous")).alias("exposure_delta_pct"),
                    F.col("l.expected").alias("expected"), "wape", FC.pct(F.col("l.actual") - F.col("l.expected"), F.col("l.expected")).alias("residual_pct"),
                    F.col("l.contribution").alias("contribution"), strength.alias("strength"))


def drivers(sales: DataFrame, parts: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(part_number, brand_drivers, model_drivers): the brands and models that moved a part most in its latest month, as 'name:+12.0'."""
    s = sales if parts is None else sales.join(parts.select("part_number"), "part_number", "left_semi")
    moves = explain_changes(s, "part_number", ["brand", "model_name"], top)
    text = F.concat("name", F.lit(":"), F.format_string("%+.1f", "delta"))
    of = lambda d: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("position", text.alias("t"))))), lambda r: r["t"]), "; ")      # noqa: E731
    return moves.groupBy("part_number").agg(of("brand").alias("brand_drivers"), of("model_name").alias("model_drivers"))


def alerts(sales: DataFrame, exposure: DataFrame, scan: int | None = None) -> DataFrame:
    """Priority score per part (every part, or the ``scan`` largest) from change, error, anomalies, shape and confidence;
    quiet parts drop out."""
    parts = top_parts(sales, scan) if scan else None
    p = part_series(sales, parts).join(exposure.select("part_number", F.col("residual_pct").alias("exposure_residual_pct"), F.col("contribution").alias("exposure_contribution"), "strength"), "part_number", "left")
    d = rate(p, F.col("exposure_residual_pct"))
    prev, z = F.when(F.col("n") >= 2, FC.back(F.col("h"), 2)).otherwise(0.0), F.lit(0.0)
    delta = FC.pct(F.col("latest") - prev, prev)
    top2 = F.slice("anomalies", 1, 2)
    prio = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REGIME_PRIORITY.items() for x in kv]), F.col("r_code")), z)
    score = (F.least(F.abs(F.coalesce(delta, z)) / 100, F.lit(2.5)) * 0.45 + F.least(F.coalesce(F.col("b_wape"), z), F.lit(1.5)) * 0.35
             + F.when(F.exists(top2, lambda a: a["severity"] == "High"), 0.35).when(F.size(top2) > 0, 0.18).otherwise(0.0) + prio
             + F.when(F.col("confidence") == "Low", 0.2).when(F.col("confidence") == "Medium", 0.08).otherwise(0.0))
    evidence = F.slice(F.filter(F.array(
        F.concat(F.lit("regime:"), "r_code"),
        F.when(delta.isNotNull(), F.concat(F.lit("change_pct:"), F.format_number(delta, 1))),
        F.concat(F.lit("recent3_pct:"), F.format_number(FC.pct(F.col("latest"), FC.amean(FC.tail(F.col("h"), 3))), 0)),
        F.when(F.col("strength").isNotNull(), F.concat(F.lit("exposure:"), F.lower("strength"))),
        F.when(F.abs("exposure_residual_pct") >= 20, F.concat(F.lit("residual_pct:"), F.format_number("exposure_residual_pct", 1))),
        F.when(F.size(top2) > 0, F.concat(F.lit("anomaly_pct:"), F.format_number(F.get(top2, 0)["delta_pct"], 1))),
        F.when(F.col("b_wape").isNotNull(), F.concat(F.lit("wape_pct:"), F.format_number(F.col("b_wape") * 100, 1)))),
        lambda x: x.isNotNull()), 1, 5)
    d = d.withColumns({"alert_score": F.round(score, 3), "raw": score, "delta_pct": delta, "previous": prev, "evidence": evidence})
    d = d.filter(~((F.col("raw") < 0.32) & (F.col("risk") == "Low") & (F.col("r_code") == "stable")))
    d = d.join(drivers(sales, parts), "part_number", "left")
    return d.select("part_number", "n", "latest", "previous", "delta_pct", "next_forecast",
                    FC.pct(F.col("next_forecast") - F.col("latest"), F.col("latest")).alias("forecast_delta_pct"), "alert_score", "risk",
                    F.col("r_code").alias("regime"), F.col("r_severity").alias("severity"), "confidence", F.col("b_wape").alias("wape"),
                    F.col("b_bias").alias("bias"), F.col("b_model").alias("model"), "strength", "exposure_contribution",
                    F.coalesce("brand_drivers", F.lit("")).alias("brand_drivers"), F.coalesce("model_drivers", F.lit("")).alias("model_drivers"), F.array_join("evidence", "; ").alias("evidence"))


def surfaced(alert_rows: DataFrame, limit: int = 12) -> DataFrame:
    rank = F.when(F.col("risk") == "High", 0).when(F.col("risk") == "Medium", 1).otherwise(2)
    return alert_rows.orderBy(F.desc("alert_score"), F.desc(rank), F.desc("latest"), "part_number").limit(limit)


def alert_summary(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.groupingSets([("regime",), ()], "regime").agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(F.col("severity") == "High").alias("structural_breaks"),
        F.count_if(F.col("risk") == "High").alias("high_risk"), F.count_if(F.col("confidence") == "Low").alias("low_confidence"))


def part_payload(packed: DataFrame, horizon: int = 3) -> DataFrame:
    """History rows and forecast rows with bounds, one table."""
    d = FC.with_best(packed.filter("n > 3"))
    hist = S.unpack(d, ["part_number"]).select("part_number", "month", F.lit("actual").alias("kind"), "value",
                                               F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    f = FC.with_path(d, "b_train", "b_model", horizon, "p")
    f = f.select("part_number", "start_ord", "n", F.posexplode(FC.band(F.col("h"), F.col("p"), F.col("b_mae"))).alias("i", "x"))
    return hist.unionByName(f.select("part_number", D.month_from_ord(F.col("start_ord") + F.col("n") + F.col("i")).alias("month"), F.lit("forecast").alias("kind"),
                                     F.col("x.forecast").alias("value"), F.col("x.lower").alias("lower"), F.col("x.upper").alias("upper")))


def nowcast(forecast: DataFrame, facts: DataFrame, latest_date: DataFrame, cal: DataFrame, key: str = "brand", value: str = "quantity") -> DataFrame:
    """Replace the open month by month-to-date actual + (1 - completion) x forecast."""
    now = latest_date.select(D.month_of("latest_date").alias("now_month"), D.month_completion(F.col("latest_date")).alias("completion"),
                             D.month_is_complete(F.col("latest_date")).alias("closed"))
    mtd = facts.groupBy(F.col(key).alias("k"), F.col("month").alias("m")).agg(F.sum(F.col(value).cast("double")).alias("actual_to_date"))
    j = (forecast.crossJoin(F.broadcast(now)).join(F.broadcast(cal), "month", "left")
         .join(mtd, (F.col(key) == F.col("k")) & (F.col("month") == F.col("m")) & (F.col("month") == F.col("now_month")), "left").drop("k", "m"))
    open_ = (F.col("month") == F.col("now_month")) & ~F.col("closed") & F.col("working_days").isNotNull()
    atd = F.coalesce("actual_to_date", F.lit(0.0))
    return j.select(*forecast.columns[:-1],
                    F.when(open_, F.greatest(F.lit(0.0), atd + (1 - F.col("completion")) * F.col("value"))).otherwise(F.col("value")).alias("value"),
                    F.when(open_, "Nowcast").otherwise("Forecast").alias("forecast_type"), F.when(open_, atd).alias("actual_to_date"),
                    F.when(open_, F.col("completion")).alias("completion"), "working_days", F.col("value").alias("baseline"),
                    F.when(open_, F.col("working_days") * F.col("completion")).alias("elapsed_working_days"))
