"""Method selection over many series at once.

``functions.forecast.select_best`` defines the choice of a method for one packed history as a Column expression. Here the
histories of an Arrow batch become one series x months matrix, and each method runs once over all series and origins of it;
tests hold both against each other. Spark deals out the series, a batch bounds the memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BASELINE_MODELS

RESULT = T.StructType([T.StructField(n, t) for n, t in (
    ("model", T.StringType()), ("preprocessing", T.StringType()), ("mae", T.DoubleType()), ("wape", T.DoubleType()), ("bias", T.DoubleType()),
    ("adjusted", T.IntegerType()), ("train", T.ArrayType(T.DoubleType())))])


def _total(columns) -> np.ndarray:
    """Sum from left to right, as the Column form adds."""
    out = 0.0
    for c in columns:
        out = out + c
    return out


def _median(a: np.ndarray) -> np.ndarray:
    s, n = np.sort(a, axis=1), a.shape[1]
    return (s[:, (n - 1) // 2] + s[:, n // 2]) / 2


def softened(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outlier-softened histories and the number of months that changed."""
    out, changed = np.zeros_like(v), np.zeros(len(v), np.int64)
    for i in range(v.shape[1]):
        x = np.maximum(v[:, i], 0.0)
        if i >= 3:
            recent = out[:, max(i - 6, 0):i]
            mid = _median(recent)
            spread = np.maximum(np.maximum(_median(np.abs(recent - mid[:, None])) * 3.0, mid * 0.7), 1.0)
            lo, hi = np.maximum(0.0, mid - spread), mid + spread
            changed += ((x < lo) | (x > hi)) & (i < n)
            x = np.maximum(0.0, np.where(x < lo, lo + (x - lo) * 0.4, np.where(x > hi, hi + (x - hi) * 0.4, x)))
        out[:, i] = x
    return out, changed


def _croston(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forecast after each month, and the months with demand so far."""
    a, (s, t) = 0.2, v.shape
    first = np.where((v > 0).any(1), v[np.arange(s), (v > 0).argmax(1)], 0.0)
    d, every, gap = first, np.ones(s), np.ones(s)
    out, hits = np.zeros((s, t + 1)), np.zeros((s, t + 1), np.int64)
    for i in range(t):
        x = v[:, i]
        hit = x > 0
        if i:
            d, every, gap = np.where(hit, x * a + d * (1 - a), d), np.where(hit, gap * a + every * (1 - a), every), np.where(hit, 1.0, gap + 1.0)
        out[:, i + 1] = np.where(every <= 0, 0.0, np.maximum(0.0, d / every * (1 - a / 2)))
        hits[:, i + 1] = hits[:, i] + hit
    return out, hits


def _ets(v: np.ndarray) -> np.ndarray:
    """Forecast after each month, of histories with two years or more."""
    alpha, beta, gamma = 0.35, 0.10, 0.25      # fixed values
    s, t = v.shape
    out = np.zeros((s, t + 1))
    if t < 24:
        return out
    m1, m2 = (_total(v[:, k + i] for i in range(12)) / 12 for k in (0, 12))
    level, trend, season = m1, (m2 - m1) / 12, [v[:, i] - m1 for i in range(12)]
    for i in range(t):
        x, old = v[:, i], season.pop(0)
        new = (x - old) * alpha + (level + trend) * (1 - alpha)
        trend = (new - level) * beta + trend * (1 - beta)
        level = new
        season.append((x - new) * gamma + old * (1 - gamma))
        out[:, i + 1] = np.maximum(0.0, level + trend * 1 + season[0])
    return out


def one_step(v: np.ndarray, row: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """One-step forecasts of every method for history ``v[row, :at]``; ``at`` is 3 or more."""
    back = lambda k: np.where(at >= k, v[row, np.maximum(at - k, 0)], 0.0)          # noqa: E731
    last = {k: back(k) for k in range(1, 13)}
    mean = lambda k: _total(last[j] for j in range(k, 0, -1)) / np.minimum(at, k)
    recent = last[1] * 0.6 + last[2] * 0.3 + last[3] * 0.1
    mean6, m6, m8 = mean(6), np.minimum(at, 6), np.minimum(at, 8)
    trend = (last[1] - v[row, at - m6]) / (m6 - 1)

    phi = 0.8                                                                       # fixed values, with 0.45 and 0.2
    level, slope = v[row, at - m8], v[row, at - m8 + 1] - v[row, at - m8]
    for k in range(7, 0, -1):
        x = last[k]
        new = x * 0.45 + (level + slope * phi) * (1 - 0.45)
        turn = (new - level) * 0.2 + slope * ((1 - 0.2) * phi)
        on = m8 > k
        level, slope = np.where(on, new, level), np.where(on, turn, slope)
    damped = np.maximum(0.0, level + slope * phi)

    y = {k: np.log1p(last[k]) for k in range(1, 7)}
    middle = (m6 - 1) / 2.0
    ym = _total(np.where(m6 >= k, y[k], 0.0) for k in range(6, 0, -1)) / m6
    place = {k: m6 - k - middle for k in range(1, 7)}
    sxy = _total(np.where(m6 >= k, y[k] * place[k], 0.0) for k in range(6, 0, -1))
    sxx = _total(np.where(m6 >= k, place[k] * place[k], 0.0) for k in range(6, 0, -1))
    slope = sxy / sxx
    log_linear = np.maximum(0.0, np.expm1(slope * m6 + (ym - slope * middle)))

    years = at // 12
    same = _total(np.where(years >= k, v[row, np.maximum(at - 12 * k, 0)], 0.0) for k in range(int(years.max(initial=0)), 0, -1))
    long, (croston, hits) = at >= 12, _croston(v)
    out = {
        "naive_last": last[1], "mean": mean6, "weighted_moving_average": recent, "trailing_12_mean": mean(12),
        "trend_adjusted_moving_average": np.maximum(0.0, recent + trend), "damped_trend": damped, "log_linear_trend": log_linear,
        "seasonal_naive": np.where(long, last[12], mean6), "seasonal_mean": np.where(long, same / np.maximum(years, 1), mean6),
        "ets_additive": np.where(at < 24, damped, _ets(v)[row, at]), "croston_sba": np.where(hits[row, at] < 2, recent, croston[row, at]),
    }
    return {k: np.maximum(x, 0.0) for k, x in out.items()}


#: Histories of one matrix. An Arrow batch is worked off in parts of so many, so that memory does not follow the batch.
AT_ONCE = 512


def _parts(histories: list) -> list[list]:
    return [histories[at:at + AT_ONCE] for at in range(0, len(histories), AT_ONCE)]


def best(histories: list[np.ndarray | None], use_seasonality: bool = True) -> list[tuple | None]:
    """(model, preprocessing, mae, wape, bias, adjusted, train) of each history; None for three months or fewer."""
    return [r for part in _parts(histories) for r in _best(part, use_seasonality)]


def _best(histories: list[np.ndarray | None], use_seasonality: bool) -> list[tuple | None]:
    out: list[tuple | None] = [None] * len(histories)
    own = [i for i, h in enumerate(histories) if h is not None and len(h) > 3]
    if not own:
        return out
    n = np.array([len(histories[i]) for i in own])
    v = np.zeros((len(own), int(n.max())))
    for k, i in enumerate(own):
        v[k, :n[k]] = histories[i]
    inside = np.arange(v.shape[1]) < n[:, None]
    zeros = ((v <= 0) & inside).sum(1) / n
    soft, changed = softened(v, n)
    start = np.maximum(3, n - np.minimum(6, np.maximum(3, n // 4)))
    row = np.repeat(np.arange(len(own)), n - start)
    at = np.concatenate([np.arange(a, b) for a, b in zip(start, n, strict=True)])
    first = np.concatenate([[0], np.cumsum(n - start)[:-1]])
    actual, count = v[row, at], n - start
    # one value a series, added up from its first origin on
    added = lambda x: _total(np.where(count > k, x[np.minimum(first + k, len(x) - 1)], 0.0) for k in range(int(count.max())))
    total = added(actual)
    fits = {}
    for m, need, family in BASELINE_MODELS:
        ok = n >= need
        if family == "seasonal":
            ok = ok & (zeros < 0.45) & use_seasonality
        if family == "intermittent":
            ok = ok & (zeros >= 0.2)
        fits[m] = ok
    score, place = [], []
    for train, prep, allowed in ((v, 0, np.ones(len(own), bool)), (soft, 100, changed > 0)):
        ahead = one_step(train, row, at)
        for k, (m, _, _) in enumerate(BASELINE_MODELS):
            p = ahead[m]
            with np.errstate(divide="ignore", invalid="ignore"):
                err, sum_p = added(np.abs(p - actual)), added(p)
                wape = np.where(total != 0, err / total, np.inf)
                off = np.where(total != 0, (sum_p - total) / total, np.inf)
            ok = fits[m] & allowed
            score.append(np.where(ok, [wape, err / count, np.abs(off), np.full(len(own), float(k + prep))], np.nan))
            place.append((m, prep, err / count, wape, off))
    keys = np.stack(score)                                     # (methods x preparations, 4, series)
    keys = np.where(np.isnan(keys[:, 3:4]), np.nan, keys)
    order = np.lexsort([np.where(np.isnan(keys[:, j]), np.inf, keys[:, j]) for j in (3, 2, 1, 0)] + [np.isnan(keys[:, 3])], axis=0)[0]
    for k, i in enumerate(own):
        m, prep, mae, wape, off = place[order[k]]
        some = bool(total[k] != 0)
        out[i] = (m, "cleaned" if prep else "raw", float(mae[k]), float(wape[k]) if some else None, float(off[k]) if some else None,
                  int(changed[k]) if prep else 0, (soft if prep else v)[k, :n[k]].copy())
    return out


ANOMALIES = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (
    ("neg", T.DoubleType()), ("position", T.IntegerType()), ("actual", T.DoubleType()), ("baseline", T.DoubleType()),
    ("delta_pct", T.DoubleType()), ("score", T.DoubleType()), ("severity", T.StringType()))]))


def _rolling(a: np.ndarray, first: int, least: int) -> np.ndarray:
    """Median of up to six values that end at each column, from ``first`` on; NaN where there are fewer than ``least``."""
    out = np.full(a.shape, np.nan)
    for i in range(first + least - 1, a.shape[1]):
        out[:, i] = _median(a[:, max(i - 5, first):i + 1])
    return out


def anomalies(histories: list[np.ndarray | None], limit: int) -> list[list[tuple] | None]:
    """The ``limit`` months of each history that lie farthest from their rolling median, by rolling spread."""
    return [r for part in _parts(histories) for r in _anomalies_of(part, limit)]


def _anomalies_of(histories: list[np.ndarray | None], limit: int) -> list[list[tuple] | None]:
    n = np.array([0 if h is None else len(h) for h in histories], np.int64)
    out: list[list[tuple] | None] = [None if h is None else [] for h in histories]
    v = np.zeros((len(n), int(n.max(initial=0))))
    for i, h in enumerate(histories):
        v[i, :n[i]] = h if n[i] else []
    mid = _rolling(v, 0, 3)
    off = np.abs(v - mid)
    spread = _rolling(off, 2, 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((spread > 0) & (np.arange(v.shape[1]) < n[:, None]) & (n[:, None] >= 5), off / spread, 0.0)
    rows, cols = np.nonzero(score >= 2.0)
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        out[i].append((-float(score[i, j]), j, float(v[i, j]), float(mid[i, j])))
    return [r and [(neg, j, x, m, (x - m) / m * 100 if m else None, -neg, "High" if -neg >= 3.5 else "Medium") for neg, j, x, m in sorted(r)[:limit]] for r in out]


@F.pandas_udf(ANOMALIES)
def _anomalies(h: pd.Series, limit: pd.Series) -> pd.Series:
    rows = anomalies(h.tolist(), int(limit.iloc[0]) if len(limit) else 0)
    return pd.Series([r if r is None else [dict(zip(ANOMALIES.elementType.names, a, strict=True)) for a in r] for r in rows], dtype=object)


def anomalies_of(h, limit: int):
    """``functions.forecast.anomalies`` for a batch of histories at a time."""
    return _anomalies(h, F.lit(limit))


@F.pandas_udf(RESULT)
def _seasonal(h: pd.Series) -> pd.DataFrame:
    return _frame(h, True)


@F.pandas_udf(RESULT)
def _unseasonal(h: pd.Series) -> pd.DataFrame:
    return _frame(h, False)


def _frame(h: pd.Series, use_seasonality: bool) -> pd.DataFrame:
    rows = [r or (None,) * 7 for r in best(h.tolist(), use_seasonality)]
    return pd.DataFrame(rows, columns=RESULT.names).astype({"adjusted": "Int32"})


def best_of(h, use_seasonality: bool = True):
    """struct(model, preprocessing, mae, wape, bias, adjusted, train) of the best method for a packed history."""
    return (_seasonal if use_seasonality else _unseasonal)(h)
