"""Exponential smoothing: a grid of candidates, fitted at every origin of every series."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BacktestContract
from ..functions import dates as D
from ..functions import forecast as FC
from . import evaluate as EV

SEASON = 12
# fixed values: names of the grid's settings
# name, trend, damped, seasonal
STRUCTURES = (("ses", False, False, False), ("holt_add", True, False, False), ("holt_damped_add", True, True, False),
              ("hw_add_add", True, False, True), ("hw_damped_add_add", True, True, True))
INITS = ("estimated", "heuristic", "legacy-heuristic")
TRANSFORMS = ("raw", "log1p", "boxcox")
WINDOWS = ("expanding", "rolling_24", "rolling_30", "rolling_36")
PREPROCESSING = ("raw", "anomaly_softened", "robust_winsorized")
# end of fixed values
#: Candidates without a search: (id, baseline method, complexity).
FIXED = (("repository_ets_additive__raw__expanding__raw", "ets_additive", 4), ("legacy_damped_trend__raw__expanding__raw", "damped_trend", 3))
#: The candidate that the governed portfolio uses for its first anchor.
TUNED = dict(structures=STRUCTURES[3:4], inits=("heuristic",), biases=(True,), transforms=("log1p",), windows=("rolling_24",), preprocessing=("robust_winsorized",))


def candidate_grid(spark, preprocessing=PREPROCESSING, structures=STRUCTURES, inits=INITS, biases=(False, True), transforms=TRANSFORMS, windows=WINDOWS) -> DataFrame:
    """Searched candidates, one row each; the fixed ones come with ``all_folds``."""
    rows = []
    for (s, tr, da, se), init, bias, t, w, p in product(structures, inits, biases, transforms, windows, preprocessing):
        mid = "__".join((s, init.replace("-", "_"), f"bias_{'on' if bias else 'off'}", t, w, p))
        cx = 1 + tr + da + 2 * se + (t != "raw") + (p != "raw")
        rows.append((mid, tr, da, se, init, bias, t, w, p, int(cx)))
    return spark.createDataFrame(rows, "model_id string, trend boolean, damped boolean, seasonal boolean, init string, bias boolean, transform string, training_window string, preprocessing string, complexity int")


def _starts(y: np.ndarray, n: np.ndarray, trend: bool, seasonal: bool, init: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First level, trend and seasonal values of every window; rows of y are windows, n their lengths."""
    rows, first = len(y), y[:, :min(10, int(n.min()))]
    season = np.zeros((rows, SEASON))
    if seasonal:
        if init == "legacy-heuristic":
            level = np.array([v[:k:SEASON].mean() for v, k in zip(y, n, strict=True)])
            season = y[:, :SEASON] - level[:, None]
            return level, (y[:, SEASON:2 * SEASON] - y[:, :SEASON]).mean(1) / SEASON if trend else np.zeros(rows), season
        for i, (v, k) in enumerate(zip(y, n, strict=True)):
            whole = v[:k // SEASON * SEASON].reshape(-1, SEASON)
            means = whole.mean(1)
            rise = (means[-1] - means[0]) / max(SEASON * (len(means) - 1), 1)
            season[i] = (whole - means[:, None] - rise * (np.arange(SEASON) - (SEASON - 1) / 2)).mean(0)      # without the trend inside a season
        first = first - season[:, :first.shape[1]]
    elif init == "legacy-heuristic":
        return y[:, 0], y[:, 1] - y[:, 0] if trend and y.shape[1] > 1 else np.zeros(rows), season
    if not trend or first.shape[1] < 2:
        return first.mean(1), np.zeros(rows), season
    x = np.arange(1, first.shape[1] + 1) - (first.shape[1] + 1) / 2
    slope = (first * x).sum(1) / (x * x).sum()
    return first.mean(1) - slope * (first.shape[1] + 1) / 2, slope, season


def _filter(y, n, a, b, g, phi, level, slope, season):
    """Run the recursions of all windows (rows, shortest first) and parameter sets (columns) side by side.

    Returns final level, trend and seasonal values, squared and summed errors. ``a`` ... ``phi`` broadcast to
    (windows, sets), as do the first states.
    """
    shape = np.broadcast_shapes(a.shape, level.shape)
    lev, tr = np.broadcast_to(level, shape).copy(), np.broadcast_to(slope, shape).copy()
    sea = np.broadcast_to(season, (SEASON, *shape)).copy()
    a, b, g, phi = (np.broadcast_to(v, shape) for v in (a, b, g, phi))
    sse, total, errors = np.zeros(shape), np.zeros(shape), np.zeros((y.shape[1], *shape))
    for i in range(y.shape[1]):
        on = slice(int(np.searchsorted(n, i, side="right")), None)            # windows longer than i
        v, s, al, be = y[on, i][:, None], sea[i % SEASON][on], a[on], b[on]
        ahead = lev[on] + phi[on] * tr[on]
        e = v - ahead - s
        errors[i][on] = e
        sse[on] += e * e
        total[on] += e
        now = ahead + al * e
        tr[on] = be * (now - lev[on]) + (1 - be) * phi[on] * tr[on]
        sea[i % SEASON][on] = s + g[on] * (v - now - s)
        lev[on] = now
    return lev, tr, sea, sse, total, errors


def fit_windows(y: np.ndarray, n: np.ndarray, trend: bool, damped: bool, seasonal: bool, init: str) -> tuple[np.ndarray, ...]:
    """Least squared one-step errors over smoothing weights, for every window; (level, trend, seasonal, phi, mean error).

    A coarse grid is refined twice around each window's best point. 'estimated' then also solves for the first
    states: errors are linear in them, so that is one least-squares problem for each window.
    """
    rows, at = len(y), np.arange(len(y))
    level, slope, season = _starts(y, n, trend, seasonal, init)
    zero = np.array([0.0])
    axes = (np.array([.05, .2, .35, .5, .7, .9]), np.array([.01, .1, .3]) if trend else zero, np.array([.05, .25, .5]) if seasonal else zero,
            np.array([.8, .9, .98]) if damped else np.array([1.0]))
    sets = [x.ravel()[None, :] for x in np.meshgrid(*axes, indexing="ij")]
    first = (level[:, None], slope[:, None], season.T[:, :, None])
    for step in range(3):
        lev, tr, sea, sse, total, _ = _filter(y, n, *sets, *first)
        q = np.argmin(np.where(np.isfinite(sse), sse, np.inf), 1)
        best = [np.broadcast_to(v, sse.shape)[at, q] for v in sets]
        if step == 2:
            break
        half = 0.5 ** (step + 1)
        moves = [np.array([-w, 0.0, w]) * half if on else zero for on, w in ((True, .2), (trend, .12), (seasonal, .2), (damped, .08))]
        grid = [m.ravel()[None, :] for m in np.meshgrid(*moves, indexing="ij")]
        ends = ((.001, .99), (.001 if trend else 0.0, .99), (.001 if seasonal else 0.0, .99), (.001, .995) if damped else (1.0, 1.0))
        sets = [np.clip(v[:, None] + d, *e) for v, d, e in zip(best, grid, ends, strict=True)]
    state = [lev[at, q], tr[at, q], sea[:, at, q].T, best[3], total[at, q] / n]
    if init == "estimated":
        # Response of errors and final states to a unit change of each first state, at the weights found.
        one = [v[:, None] for v in best]
        kinds = [(1.0, 0.0, None)] + ([(0.0, 1.0, None)] if trend else []) + ([(0.0, 0.0, j) for j in range(SEASON)] if seasonal else [])
        level1, slope1 = np.array([[k[0] for k in kinds]]), np.array([[k[1] for k in kinds]])
        season1 = np.array([[[float(k[2] == j) for k in kinds]] for j in range(SEASON)])
        width = np.zeros((rows, len(kinds)))
        l1, t1, s1, _, _, e1 = _filter(np.zeros_like(y), n, *one, level1 + width, slope1 + width, season1 + width[None])
        base = _filter(y, n, *one, level[:, None], slope[:, None], season.T[:, :, None])[5][:, :, 0]
        for i in range(rows):
            m = int(n[i])
            d = np.linalg.lstsq(e1[:m, i], -base[:m, i], rcond=None)[0]
            state[0][i] += l1[i] @ d
            state[1][i] += t1[i] @ d
            state[2][i] += s1[:, i] @ d
            state[4][i] = (base[:m, i] + e1[:m, i] @ d).mean()
    return tuple(state)


def _windows(raw: np.ndarray, soft: np.ndarray, r, ends: list[int]) -> list[np.ndarray]:
    """The history that a candidate sees at each origin."""
    source = soft if r.preprocessing == "anomaly_softened" else raw
    keep = None if r.training_window == "expanding" else int(r.training_window.split("_")[1])
    out = [source[max(0, o - keep) if keep else 0:o] for o in ends]
    if r.preprocessing == "robust_winsorized":
        for i, y in enumerate(out):
            middle = np.median(y)
            spread = np.median(np.abs(y - middle))
            out[i] = np.clip(y, max(0.0, middle - 4.5 * spread), middle + 4.5 * spread) if spread > 0 else y
    return out


def _power(y: np.ndarray) -> float:
    """Box-Cox exponent of the largest likelihood on a grid."""
    logs = np.log(y)
    def likelihood(q):
        z = logs if abs(q) < 1e-9 else (y ** q - 1) / q
        return (q - 1) * logs.sum() - len(y) / 2 * np.log(z.var() + 1e-300)
    return float(max(np.linspace(-1, 2, 31), key=likelihood))


def candidate_paths(raw: np.ndarray, soft: np.ndarray, r, ends: list[int], steps: int) -> tuple[np.ndarray, list[str | None]]:
    """Forecasts (origin, step) of one candidate at all origins ``ends``, and the error text of origins that failed."""
    windows, failed, powers = _windows(raw, soft, r, ends), [None] * len(ends), np.zeros(len(ends))
    out = np.full((len(ends), steps), np.nan)
    for i, y in enumerate(windows):
        if r.transform == "log1p":
            windows[i] = np.log1p(y)
        elif r.transform == "boxcox":
            if (y <= 0).any():
                failed[i] = "ValueError: Box-Cox needs strictly positive training values"
                continue
            q = powers[i] = _power(y)
            windows[i] = np.log(y) if abs(q) < 1e-9 else (y ** q - 1) / q
    season_ok = lambda y: r.seasonal and len(y) >= 2 * SEASON
    for seasonal in (False, True):
        own = [i for i, y in enumerate(windows) if failed[i] is None and season_ok(y) == seasonal]
        if not own:
            continue
        own.sort(key=lambda i: len(windows[i]))
        n = np.array([len(windows[i]) for i in own])
        y = np.zeros((len(own), int(n.max())))
        for k, i in enumerate(own):
            y[k, :n[k]] = windows[i]
        lev, tr, sea, phi, shift = fit_windows(y, n, r.trend, r.damped, seasonal, r.init)
        for k in range(1, steps + 1):
            f = lev + (phi[:, None] ** np.arange(1, k + 1)).sum(1) * tr + sea[np.arange(len(own)), (n + k - 1) % SEASON] + (shift if r.bias else 0.0)
            if r.transform == "log1p":
                f = np.expm1(f)
            elif r.transform == "boxcox":
                q = powers[own]
                f = np.where(np.abs(q) < 1e-9, np.exp(f), np.maximum(f * q + 1, 0.0) ** (1 / np.where(np.abs(q) < 1e-9, 1.0, q)))
            out[own, k - 1] = np.maximum(f, 0.0)
    bad = ~np.isfinite(out).all(1)
    return out, [e or ("ArithmeticError: the forecast is not finite" if b else None) for e, b in zip(failed, bad.tolist(), strict=True)]


def grid_folds(packed: DataFrame, grid: DataFrame, contract: BacktestContract = BacktestContract(), next_only: bool = False) -> DataFrame:
    """True multi-step folds of every series x candidate; a failing candidate keeps its folds, with the error's text.

    All origins of a candidate are fitted side by side as one matrix. With ``next_only`` the only origin is the end
    of the history, and actuals are null.
    """
    least, horizons = contract.minimum_training_months, contract.horizons
    top = max(horizons)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                raw, soft = np.maximum(np.asarray(r.h, dtype=float), 0.0), np.asarray(r.soft, dtype=float)
                ends = [len(raw)] if next_only else list(range(least, len(raw)))
                with np.errstate(all="ignore"):
                    paths, failed = candidate_paths(raw, soft, r, ends, top)
                for o, path, err in zip(ends, paths.tolist(), failed, strict=True):
                    out += [(r.entity, r.model_id, int(r.complexity), int(r.start_ord) + o - 1, x, float(raw[o + x - 1]) if o + x <= len(raw) else None,
                             None if err else path[x - 1], o, err) for x in horizons if next_only or o + x <= len(raw)]
            yield pd.DataFrame(out, columns=["entity", "model_id", "complexity", "last", "horizon", "actual", "prediction", "training_months", "error"])

    soft = FC.once(packed, "soft", FC.soften(F.col("h"))["v"])
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = soft.crossJoin(F.broadcast(grid)).repartition(n, "entity", "model_id")          # the grid is a fixed list of settings
    raw = rows.select("entity", "start_ord", "h", "soft", *grid.columns).mapInPandas(
        run, "entity string, model_id string, complexity int, last int, horizon int, actual double, prediction double, training_months int, error string")
    return raw.select("entity", "model_id", "complexity", D.month_from_ord(F.col("last")).alias("origin_month"), D.month_from_ord(F.col("last") + F.col("horizon")).alias("target_month"),
                      "horizon", "actual", "prediction", "training_months", "error")


def all_folds(packed: DataFrame, grid: DataFrame, contract: BacktestContract = BacktestContract()) -> DataFrame:
    """Folds of the searched candidates and of the fixed ones."""
    out = grid_folds(packed, grid, contract)
    for mid, method, complexity in FIXED:
        f = EV.folds(packed, ["entity"], method, contract)
        out = out.unionByName(f.drop("backtest_model").withColumns({"model_id": F.lit(mid), "complexity": F.lit(complexity), "error": F.lit(None).cast("string")}))
    return out
