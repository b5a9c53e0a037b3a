"""Forecast methods as Column expressions over one packed history ``ARRAY<DOUBLE>``.

A packed series holds at most one value per month, so an array has a few hundred entries at
most. Nothing here shuffles: every method, the inner back-test and the choice between methods
run as one narrow projection over the rows that hold the series.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import BASELINE_MODELS
from .kernel import best_of



def let(value: Column, body) -> Column:
    """Bind a value once for use in ``body`` (an expression would be evaluated at every use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df, name: str, value: Column, fields: tuple[str, ...] = ()):
    """Add a heavy column as the output of a generator.

    Filters and projections are never merged through a generator, so the value is computed once
    per row, however often later steps refer to it. The ``fields`` of a struct become flat columns
    ``<name>_<field>``.
    """
    if not fields:
        return df.select("*", F.explode(F.array(value)).alias(name))
    flat = [f"{name}_{f}" for f in fields]
    wide = let(value, lambda v: F.struct(*[v[f].alias(c) for f, c in zip(fields, flat, strict=True)]))
    return df.select("*", F.inline(F.array(wide)))


_MEMO: dict = {}


def memo(key: tuple, build):
    """Reuse a large expression over named columns: building one takes thousands of small calls."""
    app = SparkSession.active().sparkContext.applicationId
    for old in [k for k in _MEMO if k[0] != app]:                # expressions of a session that ended
        del _MEMO[old]
    if (app, key) not in _MEMO:
        _MEMO[(app, key)] = build()
    return _MEMO[(app, key)]


BEST = ("model", "preprocessing", "mae", "wape", "bias", "adjusted", "train")


def with_best(df, h: str = "h", name: str = "b", use_seasonality: bool = True):
    """Add columns ``<name>_model`` etc.: the best method for the history in column ``h``.

    The choice is ``select_best``'s, made for a batch of series at a time.
    """
    own = f"__{name}"
    d = df.select("*", best_of(F.col(h), use_seasonality).alias(own))
    return d.select(*df.columns, F.inline(F.array(F.struct(*[F.col(own)[f].alias(f"{name}_{f}") for f in BEST]))))


def with_path(df, h: str, model: str, horizon: int, name: str):
    """Add array ``name``: forecast of column ``h`` with the method named in column ``model``."""
    return once(df, name, memo(("path", h, model, horizon), lambda: path_by_name(F.col(h), F.col(model), horizon)))


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def amean(a: Column) -> Column:
    return F.when(F.size(a) > 0, asum(a) / F.size(a))


def tail(a: Column, k: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - (k - 1), F.lit(1)), k)


def head(a: Column, k) -> Column:
    return F.slice(a, 1, k)


def back(a: Column, k: int) -> Column:
    """k-th value from the end, null when the array is shorter."""
    return F.when(F.size(a) >= k, F.get(a, F.size(a) - k))


def _recent_weighted(a: Column) -> Column:
    return (F.when(F.size(a) >= 3, back(a, 1) * 0.6 + back(a, 2) * 0.3 + back(a, 3) * 0.1)
            .when(F.size(a) == 2, back(a, 1) * 0.65 + back(a, 2) * 0.35).otherwise(back(a, 1)))


def _mean6(h):
    return let(tail(h, 6), amean)


def _trend_adjusted(h):
    def body(r):
        trend = (back(r, 1) - F.get(r, 0)) / F.greatest(F.size(r) - 1, F.lit(1))
        return F.when(F.size(r) <= 2, _recent_weighted(r)).otherwise(F.greatest(F.lit(0.0), _recent_weighted(r) + trend))
    return let(tail(h, 6), body)


def _damped(h):
    alpha, beta, phi = 0.45, 0.2, 0.8      # fixed values

    def step(s, x):
        return let(x * alpha + (s["l"] + s["t"] * phi) * (1 - alpha), lambda lvl: F.struct(
            lvl.alias("l"), ((lvl - s["l"]) * beta + s["t"] * ((1 - beta) * phi)).alias("t")))

    def body(r):
        start = F.struct(F.get(r, 0).alias("l"), (F.get(r, 1) - F.get(r, 0)).alias("t"))
        run = F.aggregate(F.slice(r, 2, 8), start, step, lambda s: F.greatest(F.lit(0.0), s["l"] + s["t"] * phi))
        return F.when(F.size(r) <= 2, _recent_weighted(r)).otherwise(run)
    return let(tail(h, 8), body)


def _log_linear(h):
    def body(r):
        n = F.size(r)
        xm = (n - 1) / 2.0

        def fit(y):
            ym = amean(y)
            sxy = asum(F.transform(y, lambda v, i: v * (i - xm)))
            sxx = asum(F.transform(y, lambda v, i: (i - xm) * (i - xm)))
            return let(sxy / sxx, lambda b: F.greatest(F.lit(0.0), F.expm1(b * n + (ym - b * xm))))
        return F.when(n < 3, _recent_weighted(r)).otherwise(let(F.transform(r, lambda v: F.log1p(v)), fit))
    return let(tail(h, 6), body)


def _seasonal_mean(h):
    n = F.size(h)
    picks = F.filter(h, lambda v, i: ((n - i) % 12 == 0))
    return F.when(n >= 12, let(picks, amean)).otherwise(_mean6(h))


def _croston(h):
    a = 0.2

    def body(v):
        pos = F.filter(v, lambda x: x > 0)

        def step(s, x):
            hit = F.struct((x * a + s["d"] * (1 - a)).alias("d"), (s["g"] * a + s["i"] * (1 - a)).alias("i"), F.lit(1.0).alias("g"))
            miss = F.struct(s["d"].alias("d"), s["i"].alias("i"), (s["g"] + 1.0).alias("g"))
            return F.when(x > 0, hit).otherwise(miss)

        start = F.struct(F.get(pos, 0).alias("d"), F.lit(1.0).alias("i"), F.lit(1.0).alias("g"))
        run = F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), start, step,
                          lambda s: F.when(s["i"] <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), s["d"] / s["i"] * (1 - a / 2))))
        return F.when(F.size(pos) < 2, _recent_weighted(tail(v, 3))).otherwise(run)
    return body(h)


_NEXT = {
    "naive_last": lambda h: back(h, 1),
    "mean": _mean6,
    "weighted_moving_average": _recent_weighted,
    "trailing_12_mean": lambda h: let(tail(h, 12), amean),
    "trend_adjusted_moving_average": _trend_adjusted,
    "damped_trend": _damped,
    "log_linear_trend": _log_linear,
    "seasonal_naive": lambda h: F.when(F.size(h) >= 12, back(h, 12)).otherwise(_mean6(h)),
    "seasonal_mean": _seasonal_mean,
    "croston_sba": _croston,
}


def _recursive(h: Column, model: str, horizon: int) -> Column:
    nxt = lambda a: F.greatest(_NEXT[model](a), F.lit(0.0))
    if horizon == 1:
        return F.array(nxt(h))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), h, lambda a, _: F.concat(a, F.array(nxt(a))))
    return F.slice(grown, -horizon, horizon)


def _ets(h: Column, horizon: int) -> Column:
    alpha, beta, gamma = 0.35, 0.10, 0.25      # fixed values

    def run(v):
        m1, m2 = amean(F.slice(v, 1, 12)), amean(F.slice(v, 13, 12))
        start = let(m1, lambda a: F.struct(a.alias("l"), ((m2 - a) / 12).alias("t"),
                                           F.transform(F.slice(v, 1, 12), lambda x: x - a).alias("s")))

        def step(s, x):
            lvl = (x - F.get(s["s"], 0)) * alpha + (s["l"] + s["t"]) * (1 - alpha)
            return let(lvl, lambda q: F.struct(
                q.alias("l"), ((q - s["l"]) * beta + s["t"] * (1 - beta)).alias("t"),
                F.concat(F.slice(s["s"], 2, 11), F.array((x - q) * gamma + F.get(s["s"], 0) * (1 - gamma))).alias("s")))

        def finish(s):
            return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.greatest(
                F.lit(0.0), s["l"] + s["t"] * k + F.get(s["s"], (k - 1) % 12)))
        return F.aggregate(v, start, step, finish)
    return F.when(F.size(h) < 24, _recursive(h, "damped_trend", horizon)).otherwise(run(h))


def path(h: Column, model: str, horizon: int) -> Column:
    """Forecast of the next ``horizon`` months as an array; an empty history gives zeros."""
    out = _ets(h, horizon) if model == "ets_additive" else _recursive(h, model, horizon)
    return F.when(F.size(h) == 0, F.array_repeat(F.lit(0.0), horizon)).otherwise(out)


def path_by_name(h: Column, name: Column, horizon: int) -> Column:
    """Forecast with the method named per row."""
    out = None
    for m, _, _ in BASELINE_MODELS:
        e = path(h, m, horizon)
        out = F.when(name == m, e) if out is None else out.when(name == m, e)
    return out


def working_day_seasonal(h: Column, ratios: Column) -> Column:
    """Value twelve back times a day ratio per step; ``ratios`` has one entry per horizon month."""
    grown = F.aggregate(ratios, h, lambda a, r: F.concat(a, F.array(
        F.greatest(F.when(F.size(a) >= 12, back(a, 12)).otherwise(back(a, 1)) * r, F.lit(0.0)))))
    return F.slice(grown, F.size(h) + 1, F.size(ratios))


def soften(h: Column) -> Column:
    """Outlier-softened history: struct(values, adjusted count). Depends on earlier *softened* values."""
    def step(s, raw):
        x = F.greatest(raw, F.lit(0.0))

        def judged(t):
            def with_base(b):
                def with_spread(sp):
                    lo, hi = F.greatest(F.lit(0.0), b - sp), b + sp
                    y = F.when(x < lo, lo + (x - lo) * 0.4).when(x > hi, hi + (x - hi) * 0.4).otherwise(x)
                    return F.struct(F.concat(s["v"], F.array(F.greatest(F.lit(0.0), y))).alias("v"),
                                    (s["n"] + F.when((x < lo) | (x > hi), 1).otherwise(0)).alias("n"))
                mad = small_median(F.transform(t, lambda q: F.abs(q - b)))
                return let(F.greatest(mad * 3.0, b * 0.7, F.lit(1.0)), with_spread)
            return let(small_median(t), with_base)
        keep = F.struct(F.concat(s["v"], F.array(x)).alias("v"), s["n"].alias("n"))
        return F.when(F.size(s["v"]) < 3, keep).otherwise(let(tail(s["v"], 6), judged))
    start = F.struct(F.array().cast("array<double>").alias("v"), F.lit(0).alias("n"))
    return F.aggregate(h, start, step)


def small_median(a: Column) -> Column:
    n = F.size(a)
    return let(F.array_sort(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def zero_share(h: Column) -> Column:
    return F.when(F.size(h) > 0, F.size(F.filter(h, lambda x: x <= 0)) / F.size(h)).otherwise(0.0)


def eligible(h: Column, spec, use_seasonality: bool = True) -> Column:
    _, need, family = spec
    ok = F.size(h) >= need
    if family == "seasonal":
        ok = ok & F.lit(use_seasonality) & (zero_share(h) < 0.45)
    if family == "intermittent":
        ok = ok & (zero_share(h) >= 0.2)
    return ok


def candidates(h: Column, use_seasonality: bool = True) -> Column:
    """Names of the methods a history supports, in fixed order; ['mean'] when none fits."""
    names = F.filter(F.array(*[F.when(eligible(h, s, use_seasonality), s[0]) for s in BASELINE_MODELS]), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("mean")))


def holdout_start(h: Column) -> Column:
    n = F.size(h)
    return F.greatest(F.lit(3), n - F.least(F.lit(6), F.greatest(F.lit(3), F.floor(n / 4).cast("int"))))


def backtest_errors(h: Column, train: Column, model: str) -> Column:
    """struct(mae, wape, bias) of one-step forecasts over the last months; null when too short.

    ``train`` is the (raw or softened) history: softening only looks back, so its prefix equals
    the softened prefix and is computed once.
    """
    n, start = F.size(h), holdout_start(h)
    preds = F.transform(F.sequence(start, n - 1), lambda i: let(F.slice(train, 1, i), lambda t: F.get(path(t, model, 1), 0)))

    def score(p):
        act = F.slice(h, start + 1, n)
        err = asum(F.zip_with(p, act, lambda a, b: F.abs(a - b)))
        tot = asum(act)
        return F.struct((err / F.size(p)).alias("mae"), F.when(tot != 0, err / tot).alias("wape"),
                        F.when(tot != 0, (asum(p) - tot) / tot).alias("bias"))
    return F.when(n > start, let(preds, score))


def select_best(h: Column, use_seasonality: bool = True) -> Column:
    """struct(model, preprocessing, mae, wape, bias, adjusted, train) of the best method.

    Lowest WAPE, then MAE, then |bias|, then the fixed candidate order; the softened history
    competes only when it changed something. Null when the series has three months or fewer.
    """
    inf = F.lit(float("inf"))

    def choose(s):
        v, zs, c = s["h"], s["zs"], s["c"]
        n = F.size(v)
        start = holdout_start(v)
        fits = []
        for _, need, family in BASELINE_MODELS:
            ok = n >= need
            if family == "seasonal":
                ok = ok & (zs < 0.45) if use_seasonality else F.lit(False)
            if family == "intermittent":
                ok = ok & (zs >= 0.2)
            fits.append(ok)
        fits[1] = fits[1] | (n < 2)                      # the mean stands in when nothing fits
        raw = F.struct(v.alias("t"), F.lit("raw").alias("prep"), F.lit(0).alias("adj"))
        soft = F.struct(c["v"].alias("t"), F.lit("cleaned").alias("prep"), c["n"].alias("adj"))
        trains = F.when(c["n"] > 0, F.array(raw, soft)).otherwise(F.array(raw))

        def per_train(tr):
            t = tr["t"]
            # one entry per origin: the one-step forecasts of all methods (null where one does not fit)
            grid = F.transform(F.sequence(start, n - 1), lambda i: let(F.slice(t, 1, i), lambda p: F.array(*[
                F.when(ok, F.get(path(p, m[0], 1), 0)) for ok, m in zip(fits, BASELINE_MODELS, strict=True)])))

            def score(g):
                act = F.slice(v, start + 1, n)

                def one(name, k):
                    p = F.transform(g, lambda row: F.get(row, k))
                    return let(F.struct(asum(F.zip_with(p, act, lambda a, b: F.abs(a - b))).alias("e"), asum(act).alias("t"),
                                        asum(p).alias("p"), F.size(act).alias("c")), lambda q: F.struct(
                        F.when(q["t"] != 0, q["e"] / q["t"]).otherwise(inf).alias("w"), (q["e"] / q["c"]).alias("m"),
                        F.when(q["t"] != 0, F.abs((q["p"] - q["t"]) / q["t"])).otherwise(inf).alias("b"),
                        (k + F.when(tr["prep"] == "raw", 0).otherwise(100)).alias("k"), name.alias("model"), tr["prep"].alias("prep"),
                        (q["e"] / q["c"]).alias("mae"), F.when(q["t"] != 0, q["e"] / q["t"]).alias("wape"),
                        F.when(q["t"] != 0, (q["p"] - q["t"]) / q["t"]).alias("bias"), tr["adj"].alias("adj")))
                names = F.array(*[F.lit(m[0]) for m in BASELINE_MODELS])
                rows = F.transform(names, one)
                return F.array_min(F.filter(rows, lambda r: F.get(F.get(g, 0), r["k"] % 100).isNotNull()))
            return let(grid, score)
        return let(F.array_min(F.transform(trains, per_train)), lambda b: F.struct(
            b["model"].alias("model"), b["prep"].alias("preprocessing"), b["mae"].alias("mae"), b["wape"].alias("wape"),
            b["bias"].alias("bias"), b["adj"].alias("adjusted"), F.when(b["prep"] == "cleaned", c["v"]).otherwise(v).alias("train")))
    best = let(let(h, lambda x: F.struct(x.alias("h"), zero_share(x).alias("zs"), soften(x).alias("c"))), choose)
    return F.when(F.size(h) > 3, best)


def pop_std(a: Column) -> Column:
    return let(amean(a), lambda m: F.sqrt(amean(F.transform(a, lambda x: (x - m) * (x - m)))))


def confidence(h: Column, wape: Column, bias: Column) -> Column:
    pos = F.filter(h, lambda x: x != 0)
    level = F.coalesce(amean(pos), amean(h), F.lit(0.0))
    vol = F.when(level > 0, pop_std(h) / level).otherwise(1.5)
    b, n = F.coalesce(F.abs(bias), F.lit(1.0)), F.size(h)
    return let(vol, lambda v: F.when(wape.isNull(), "Low")
               .when((n >= 18) & (wape <= 0.25) & (v <= 0.8) & (b <= 0.2), "High")
               .when((n >= 12) & (wape <= 0.45) & (v <= 1.25) & (b <= 0.45), "Medium").otherwise("Low"))


def band(h: Column, values: Column, mae: Column) -> Column:
    """Array of struct(forecast, lower, upper) around each step."""
    diffs = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.abs(x - F.get(h, i)))
    base = F.coalesce(mae, F.when(F.size(h) > 1, amean(diffs)).otherwise(amean(h) * 0.2), F.lit(0.0))
    return let(base, lambda e: F.transform(values, lambda v, i: let(
        F.greatest(e, v * 0.12) * F.sqrt(i + 1.0) * 1.28,
        lambda s: F.struct(v.alias("forecast"), F.greatest(F.lit(0.0), v - s).alias("lower"), (v + s).alias("upper")))))


def pct(delta: Column, base: Column) -> Column:
    return delta / F.nullif(base, F.lit(0.0)) * 100


def regime(h: Column) -> Column:
    """struct(code, label, severity, change_pct, shift_pct, volatility) of the series shape."""
    n = F.size(h)
    prior = F.when(n >= 6, F.slice(h, n - 5, 3)).otherwise(F.slice(h, 1, F.greatest(n - 3, F.lit(0))))

    def body(s):
        rec, pri, lat, prev = s["rec"], s["pri"], back(h, 1), back(h, 2)
        code = (F.when(n < 4, "sparse_history")
                .when((pri > 0) & (rec <= pri * 0.45) & (lat <= pri * 0.25) & (prev <= pri * 0.45), "structural_drop")
                .when((pri > 0) & (rec >= pri * 1.8) & (lat >= F.greatest(pri * 1.6, s["med"] * 1.5)), "structural_ramp")
                .when((pri > 0) & (rec <= pri * 0.7), "declining").when((pri > 0) & (rec >= pri * 1.35), "accelerating")
                .when(s["vol"] >= 0.95, "volatile").otherwise("stable"))
        full = n >= 4
        return let(code, lambda c: F.struct(
            c.alias("code"), F.initcap(F.lower(F.replace(c, F.lit("_"), F.lit(" ")))).alias("label"),
            F.when(c.isin("structural_drop", "structural_ramp"), "High").when(c == "stable", "Low").otherwise("Medium").alias("severity"),
            F.when(full, pct(lat - prev, prev)).alias("change_pct"),
            F.when(full & (pri > 0), pct(rec - pri, pri)).alias("shift_pct"), F.when(full, s["vol"]).alias("volatility")))
    mean = amean(h)
    return let(F.struct(amean(tail(h, 3)).alias("rec"), F.coalesce(amean(prior), F.lit(0.0)).alias("pri"),
                        small_median(h).alias("med"), F.when(mean > 0, pop_std(h) / mean).alias("vol")), body)


def anomalies(h: Column, limit: int = 4) -> Column:
    """Array of struct(position, actual, baseline, delta_pct, score, severity), largest score first."""
    n = F.size(h)
    win = lambda a, i: F.slice(a, F.greatest(i - 4, F.lit(1)), F.least(i + 1, F.lit(6)))
    med = F.transform(h, lambda x, i: F.when(i >= 2, small_median(win(h, i))))

    def with_med(m):
        resid = F.transform(h, lambda x, i: F.abs(x - F.get(m, i)))

        def with_resid(r):
            def one(x, i):
                w = F.filter(win(r, i), lambda q: q.isNotNull())
                mad = F.when(F.size(w) >= 3, small_median(w))
                sc = F.coalesce(F.get(r, i) / F.nullif(mad, F.lit(0.0)), F.lit(0.0))
                return F.struct((-sc).alias("neg"), i.alias("position"), x.alias("actual"), F.get(m, i).alias("baseline"),
                                pct(x - F.get(m, i), F.get(m, i)).alias("delta_pct"), sc.alias("score"),
                                F.when(sc >= 3.5, "High").otherwise("Medium").alias("severity"))
            return F.slice(F.array_sort(F.filter(F.transform(h, one), lambda a: a["score"] >= 2.0)), 1, limit)
        return let(resid, with_resid)
    empty = F.slice(let(med, with_med), 1, 0)
    return F.when(n < 5, empty).otherwise(let(med, with_med))


def risk(conf: Column, wape: Column, bias: Column, code: Column, n_anomalies: Column, residual_pct: Column | None = None) -> Column:
    high = (conf == "Low") | F.coalesce(wape >= 0.55, F.lit(False)) | code.isin("structural_drop", "structural_ramp")
    if residual_pct is not None:
        high = high | F.coalesce(F.abs(residual_pct) >= 45, F.lit(False))
    calm = (n_anomalies == 0) & (code == "stable") & F.coalesce(wape <= 0.22, F.lit(False)) & F.coalesce(F.abs(bias) <= 0.2, F.lit(True))
    mid = ((n_anomalies > 0) | code.isin("declining", "accelerating", "volatile")
           | F.coalesce(wape > 0.22, F.lit(False)) | F.coalesce(F.abs(bias) > 0.2, F.lit(False)))
    return F.when(high, "High").when(calm, "Low").when(mid, "Medium").otherwise("Low")


def tier(n: Column, risk_: Column, code: Column, wape: Column, bias: Column, vol: Column) -> Column:
    stop = (n < 6) | (risk_ == "High") | code.isin("structural_drop", "structural_ramp", "sparse_history") | wape.isNull() | (wape > 0.45)
    ready = ((n >= 12) & (wape <= 0.22) & F.coalesce(F.abs(bias) <= 0.18, F.lit(True)) & (code == "stable") & (risk_ == "Low")
             & F.coalesce(vol <= 0.85, F.lit(True)))
    return F.when(stop, "do_not_auto_plan").when(ready, "planner_ready").otherwise("needs_review")


def reliability(n: Column, wape: Column, bias: Column, conf: Column, code: Column, risk_: Column) -> Column:
    from ..config import REGIME_PENALTY
    pen = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REGIME_PENALTY.items() for x in kv]), code), F.lit(6.0))
    one = F.lit(1.0)
    score = (F.least(n / 18.0, one) * 22.0 + F.when(wape.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), one - F.least(wape, one)) * 38.0)
             + F.greatest(F.lit(0.0), one - F.least(F.coalesce(F.abs(bias), one), one)) * 14.0
             + F.when(conf == "High", 14.0).when(conf == "Medium", 8.0).when(conf == "Low", 2.0).otherwise(0.0)
             - pen - F.when(risk_ == "Low", 0.0).when(risk_ == "Medium", 7.0).when(risk_ == "High", 18.0).otherwise(10.0))
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(100.0))), 1)
