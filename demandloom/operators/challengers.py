"""Learned challengers of the governed portfolio, refitted at every origin on what was known there."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ANCHOR_METHODS, BacktestContract
from ..functions import dates as D
from ..functions import forecast as FC
from . import evaluate as EV
from . import forecasting as FO
from . import ml as ML
from . import smoothing as SM

# --- fixed values: settings of the published challengers --------------------------------
TREE, ELASTIC = "tree_meta_selector_v1", "elastic_net_anchor_residual_v1"
ALPHAS, L1_SHARES, CLIPS = (0.001, 0.01, 0.05, 0.1, 0.2, 0.5), (0.25, 0.5, 0.75), (0.05, 0.10, 0.15)
SAFE_GAIN, INNER_ORIGINS, MIN_LEAF, MIN_ELASTIC, THRESHOLDS = 0.005, 6, 6, 18, 24
# --- end of fixed values -----------------------------------------------------------------

#: Anchor first, then blends by falling weight of the anchor: the first least error wins ties.
POLICIES = [("anchor", None, 1.0)] + [(f"{w}*anchor+{round(1 - w, 1)}*{m}", m, w) for w in sorted(ML.ANCHOR_WEIGHTS, reverse=True) for m in ML.ALTERNATIVES]
FOLD = ["entity", "origin_month", "target_month", "horizon", "actual", "prediction"]


def governed_folds(packed: DataFrame, cal: DataFrame, contract: BacktestContract = BacktestContract()) -> DataFrame:
    """Fold rows of the governed portfolio: tuned smoothing, last month, and working-day seasonal, by anchor."""
    has = lambda method: packed.filter(F.col("entity").isin(*[e for e, m in ANCHOR_METHODS.items() if m == method]))
    tuned = SM.grid_folds(has("tuned_smoothing"), SM.candidate_grid(packed.sparkSession, **SM.TUNED), contract)
    last = EV.folds(has("naive_last"), ["entity"], "naive_last", contract)
    days = has("working_day_adjusted_seasonal").crossJoin(F.broadcast(FO.calendar_row(cal)))
    seasonal = EV.folds_working_day(days, ["entity"], contract)
    cols = [*FOLD, "backtest_model", "training_months"]
    return tuned.withColumnRenamed("model_id", "backtest_model").select(*cols).unionByName(last.select(*cols)).unionByName(seasonal.select(*cols))


def governed_next(packed: DataFrame, cal: DataFrame, horizon: int = 3) -> DataFrame:
    """(entity, model, forecast array) of the governed portfolio from the end of every anchor's history."""
    other = set(packed.select("entity").distinct().limit(len(ANCHOR_METHODS) + 1).toPandas()["entity"]) - set(ANCHOR_METHODS)
    if other:
        raise ValueError(f"the governed portfolio has no method for {sorted(map(str, other))}")
    has = lambda method: packed.filter(F.col("entity").isin(*[e for e, m in ANCHOR_METHODS.items() if m == method]))
    contract = BacktestContract(horizons=tuple(range(1, horizon + 1)))
    tuned = SM.grid_folds(has("tuned_smoothing"), SM.candidate_grid(packed.sparkSession, **SM.TUNED), contract, next_only=True).groupBy("entity").agg(
        F.first("model_id").alias("model"), F.transform(F.array_sort(F.collect_list(F.struct("horizon", "prediction"))), lambda x: x["prediction"]).alias("forecast"))
    last = has("naive_last").select("entity", F.lit("naive_last").alias("model"), FC.path(F.col("h"), "naive_last", horizon).alias("forecast"))
    end = F.col("start_ord") + F.size("h") - 1
    ratios = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.coalesce(
        F.try_divide(F.try_element_at("days", end + k), F.try_element_at("days", end + k - 12)), F.lit(1.0)))
    seasonal = has("working_day_adjusted_seasonal").crossJoin(F.broadcast(FO.calendar_row(cal))).select(
        "entity", F.lit("working_day_adjusted_seasonal").alias("model"), FC.working_day_seasonal(F.col("h"), ratios).alias("forecast"))
    return tuned.unionByName(last).unionByName(seasonal)


def governed_examples(packed: DataFrame, cal: DataFrame, contract: BacktestContract = BacktestContract(), next_only: bool = False) -> DataFrame:
    """``ml.examples`` with the governed portfolio as the anchor; with ``next_only`` those of the months to come."""
    ex = ML.examples(packed, FO.calendar_row(cal), F.lit("naive_last"), tuple(ANCHOR_METHODS), contract, next_only).drop("anchor", "log_anchor", "residual")
    if next_only:
        g = governed_next(packed, cal, max(contract.horizons)).select("entity", F.posexplode("forecast").alias("i", "anchor")).select(
            "entity", (F.col("i") + 1).alias("horizon"), "anchor")
        ex = ex.join(g, ["entity", "horizon"])
    else:
        g = governed_folds(packed, cal, contract).select("entity", "origin_month", "horizon", F.col("prediction").alias("anchor"))
        ex = ex.join(g, ["entity", "origin_month", "horizon"])
    return ex.withColumn("log_anchor", F.log1p("anchor")).withColumn("residual", F.log1p("actual") - F.log1p("anchor"))


# --- policy tree ----------------------------------------------------------------------------

def _blends(ex: pd.DataFrame) -> np.ndarray:
    """Prediction of every policy (columns) for every example (rows)."""
    a = ex["anchor"].to_numpy(float)
    return np.stack([a if m is None else w * a + (1 - w) * ex[f"p_{m}"].to_numpy(float) for _, m, w in POLICIES], 1)


def _choice(errors: np.ndarray, actual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(policy, its error) from summed errors by policy (last axis): a blend only where it clearly beats the anchor."""
    k = np.argmin(errors, -1)
    least = np.take_along_axis(errors, k[..., None], -1)[..., 0]
    gain = np.where(actual > 0, (errors[..., 0] - least) / np.where(actual > 0, actual, 1.0), 0.0)
    k = np.where(gain > SAFE_GAIN, k, 0)
    return k, np.take_along_axis(errors, k[..., None], -1)[..., 0]


def grow(x: np.ndarray, errors: np.ndarray, actual: np.ndarray, depth: int = 2) -> dict:
    """Tree of policies: a node splits where both sides' own policies have less error than one policy for all.

    Thresholds lie midway between neighbouring values of a feature, thinned evenly above ``THRESHOLDS``; both sides
    keep ``MIN_LEAF`` examples. All thresholds of a feature are judged at once from running sums.
    """
    k, loss = _choice(errors.sum(0), actual.sum())
    node = {"policy": int(k), "rows": len(x), "error": float(loss)}
    if depth == 0 or len(x) < 2 * MIN_LEAF:
        return node
    best = (1e-12, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values = x[order, f]
        distinct = np.unique(values)
        cuts = (distinct[:-1] + distinct[1:]) / 2
        if len(cuts) > THRESHOLDS:
            cuts = cuts[np.linspace(0, len(cuts) - 1, THRESHOLDS).round().astype(int)]
        left = np.searchsorted(values, cuts, side="right")
        cuts, left = cuts[(left >= MIN_LEAF) & (len(x) - left >= MIN_LEAF)], left[(left >= MIN_LEAF) & (len(x) - left >= MIN_LEAF)]
        if not len(cuts):
            continue
        e, a = errors[order].cumsum(0), actual[order].cumsum()
        low, high = _choice(e[left - 1], a[left - 1])[1], _choice(e[-1] - e[left - 1], a[-1] - a[left - 1])[1]
        gain = loss - low - high
        at = int(np.argmax(gain))
        if gain[at] > best[0] + (1e-12 if best[1] is not None else 0.0):
            best = (float(gain[at]), f, float(cuts[at]))
    if best[1] is None:
        return node
    side = x[:, best[1]] <= best[2]
    return node | {"feature": best[1], "threshold": best[2], "left": grow(x[side], errors[side], actual[side], depth - 1),
                   "right": grow(x[~side], errors[~side], actual[~side], depth - 1)}


def route(tree: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(policy, leaf path) of every example."""
    if "feature" not in tree:
        return np.full(len(x), tree["policy"]), np.full(len(x), "", object)
    side = x[:, tree["feature"]] <= tree["threshold"]
    policy, path = np.zeros(len(x), int), np.full(len(x), "", object)
    for name, on in (("left", side), ("right", ~side)):
        p, q = route(tree[name], x[on])
        policy[on], path[on] = p, np.array([name[0].upper() + v for v in q], object)
    return policy, path


def fit_tree(ex: pd.DataFrame) -> dict:
    actual = ex["actual"].to_numpy(float)
    errors = np.abs(_blends(ex) - actual[:, None])
    x = ex[ML.feature_names()].to_numpy(float)
    return grow(x, errors, np.abs(actual), depth=2 if len(ex) >= 2 * MIN_LEAF else 0) | {"cold": len(ex) < 2 * MIN_LEAF}


def predict_tree(tree: dict, ex: pd.DataFrame) -> np.ndarray:
    policy, _ = route(tree, ex[ML.feature_names()].to_numpy(float))
    return np.maximum(_blends(ex)[np.arange(len(ex)), policy], 0.0)


# --- residual elastic net ---------------------------------------------------------------------

def _descend(ex: pd.DataFrame, settings: list[tuple[float, float]], sweeps: int = 80) -> dict:
    """Weighted elastic nets on standardized features for all settings at once, by coordinate descent on their moments."""
    x, y = ex[ML.feature_names()].to_numpy(float), ex["residual"].to_numpy(float)
    w = np.maximum(ex["actual"].to_numpy(float), 0.0)
    w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
    mean = w @ x
    scale = np.sqrt(w @ (x - mean) ** 2)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z, level = (x - mean) / scale, float(w @ y)
    gram, cross = (z * w[:, None]).T @ z, (z * w[:, None]).T @ (y - level)
    alpha, share = (np.array(v) for v in zip(*settings, strict=True))
    beta = np.zeros((len(settings), x.shape[1]))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(x.shape[1]):
            rho = cross[j] - beta @ gram[j] + beta[:, j] * gram[j, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - alpha * share, 0.0) / np.maximum(gram[j, j] + alpha * (1 - share), 1e-300)
            moved = max(moved, float(np.abs(new - beta[:, j]).max()))
            beta[:, j] = new
        if moved < 1e-6:
            break
    return {"mean": mean, "scale": scale, "level": level, "beta": beta}


def _shifted(anchor: np.ndarray, raw: np.ndarray, clip: float) -> np.ndarray:
    return np.maximum(np.expm1(np.log1p(anchor) + np.clip(raw, -clip, clip)), 0.0)


class _Totals:
    """Error of the sums over all anchors, on the folds that every anchor has."""

    def __init__(self, ex: pd.DataFrame) -> None:
        by = ex.groupby(["origin_month", "target_month", "horizon"])
        whole = (by["entity"].transform("nunique") == len(ANCHOR_METHODS)).to_numpy()
        self.rows, self.fold = np.flatnonzero(whole), by.ngroup().to_numpy()[whole]
        self.actual = np.bincount(self.fold, ex["actual"].to_numpy(float)[whole]) if whole.any() else np.zeros(0)

    def wape(self, prediction: np.ndarray) -> float:
        total = np.abs(self.actual).sum()
        return float(np.abs(np.bincount(self.fold, prediction[self.rows]) - self.actual).sum() / total) if total > 0 else np.inf


def fit_elastic(ex: pd.DataFrame) -> dict:
    """Elastic net on log residuals of the anchor, its setting chosen on the last origins; no correction without a clear gain."""
    none = {"clip": 0.0, "cold": len(ex) < MIN_ELASTIC, "alpha": None, "l1": None}
    if none["cold"]:
        return none
    origins = sorted(ex["origin_month"].unique())
    late = ex["origin_month"].isin(origins[-INNER_ORIGINS:])
    if len(origins) < INNER_ORIGINS + 2 or (~late).sum() < MIN_ELASTIC:
        return none
    settings = [(a, s) for a in ALPHAS for s in L1_SHARES]
    inner, test = _descend(ex[~late], settings), ex[late]
    totals, anchor = _Totals(test), np.maximum(test["anchor"].to_numpy(float), 0.0)
    raw = inner["level"] + inner["beta"] @ ((test[ML.feature_names()].to_numpy(float) - inner["mean"]) / inner["scale"]).T
    scores = [(totals.wape(_shifted(anchor, raw[k], c)), -a, -s, c) for k, (a, s) in enumerate(settings) for c in CLIPS]
    wape, alpha, share, clip = min(scores)
    if not totals.wape(anchor) - wape > SAFE_GAIN:
        return none
    return _descend(ex, [(-alpha, -share)]) | {"clip": clip, "cold": False, "alpha": -alpha, "l1": -share}


def predict_elastic(model: dict, ex: pd.DataFrame) -> np.ndarray:
    anchor = np.maximum(ex["anchor"].to_numpy(float), 0.0)
    if not model["clip"]:
        return anchor
    z = (ex[ML.feature_names()].to_numpy(float) - model["mean"]) / model["scale"]
    return _shifted(anchor, model["level"] + z @ model["beta"][0], model["clip"])


# --- at scale: origins in parallel ---------------------------------------------------------------

FOLD_SCHEMA = "entity string, origin_month string, target_month string, horizon int, actual double, prediction double, model_id string, label string"


def nested_folds(ex: DataFrame) -> DataFrame:
    """Fold rows of both challengers: at each origin they learn from targets up to that origin only.

    Every origin is its own group with the examples it may see, so origins are fitted in parallel; a group is bounded
    by months x anchors x horizons.
    """
    origins = ex.agg(F.array_sort(F.collect_set("origin_month")).alias("origins"))                # one row, one entry per month
    seen = ex.crossJoin(F.broadcast(origins)).withColumn("at", F.explode(F.filter(
        "origins", lambda o: (o >= F.col("target_month")) | (o == F.col("origin_month"))))).drop("origins")

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["origin_month", "horizon", "entity"])
        past, test = pdf[pdf["target_month"] <= key[0]], pdf[pdf["origin_month"] == key[0]]
        tree = fit_tree(past) if len(past) else {"policy": 0, "cold": True}
        net = fit_elastic(past)
        policy = route(tree, test[ML.feature_names()].to_numpy(float))[0]
        own = test[["entity", "origin_month", "target_month", "horizon", "actual"]]
        cold = lambda m: ":cold_start_anchor" if m["cold"] else ""
        return pd.concat([own.assign(prediction=predict_tree(tree, test), model_id=TREE, label=[f"{POLICIES[k][0]}{cold(tree)}" for k in policy]),
                          own.assign(prediction=predict_elastic(net, test), model_id=ELASTIC, label=f"clip={net['clip']}{cold(net)}")])
    n = int(ex.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seen.repartition(n, "at").groupBy("at").applyInPandas(fold, FOLD_SCHEMA)              # small groups, costly fits: not merged by size


def stored_models(ex: DataFrame, source: DataFrame) -> DataFrame:
    """Both challengers fitted to all examples: (model_id, model as JSON, fingerprint of the source)."""
    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["origin_month", "horizon", "entity"])
        net = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in fit_elastic(pdf).items()}
        return pd.DataFrame({"model_id": [TREE, ELASTIC], "model": [json.dumps(fit_tree(pdf)), json.dumps(net)]})
    m = ex.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fitted, "model_id string, model string")               # months x anchors x horizons
    return m.crossJoin(F.broadcast(source.select("fingerprint")))                                  # one row


def stored_forecast(stored: DataFrame, source: DataFrame, ahead: DataFrame) -> DataFrame:
    """Forecasts of stored challengers for the examples ``ahead``; no rows if the table at hand is not the one they learned from."""
    usable = stored.join(F.broadcast(source.select("fingerprint")), "fingerprint", "left_semi")

    def predicted(pdf: pd.DataFrame) -> pd.DataFrame:
        name, model = pdf["model_id"].iloc[0], json.loads(pdf["model"].iloc[0])
        model = {k: np.array(v) if isinstance(v, list) else v for k, v in model.items()}
        return pdf[["entity", "target_month", "horizon", "model_id"]].assign(prediction=predict_tree(model, pdf) if name == TREE else predict_elastic(model, pdf))
    both = ahead.crossJoin(F.broadcast(usable.drop("fingerprint")))                                # two rows
    return both.groupBy("model_id").applyInPandas(predicted, "entity string, target_month string, horizon int, model_id string, prediction double")


def leaves(ex: DataFrame) -> DataFrame:
    """Leaves of the policy tree over all examples: path, rows, error, policy."""
    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        def walk(t, path):
            return [(path, t["rows"], t["error"], POLICIES[t["policy"]][0])] if "feature" not in t else walk(t["left"], path + "L") + walk(t["right"], path + "R")
        return pd.DataFrame(walk(fit_tree(pdf.sort_values(["origin_month", "horizon", "entity"])), "r"), columns=["node", "rows", "error", "policy"])
    return ex.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(grown, "node string, rows long, error double, policy string")


def strategy(packed: DataFrame, cal: DataFrame, name: str, horizon: int = 3, stored: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """(entity, model, forecast array) by the governed portfolio or by a stored challenger (with the source at hand)."""
    if name == "reference_portfolio":
        return governed_next(packed, cal, horizon)
    if name not in (TREE, ELASTIC):
        raise ValueError(f"unknown strategy {name!r}")
    if stored is None or source is None:
        raise ValueError(f"{name} needs stored models and the fingerprint of the source")
    ahead = governed_examples(packed, cal, BacktestContract(horizons=tuple(range(1, horizon + 1))), next_only=True)
    f = stored_forecast(stored.filter(F.col("model_id") == name), source, ahead)
    return f.groupBy("entity", F.col("model_id").alias("model")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("horizon", "prediction"))), lambda x: x["prediction"]).alias("forecast"))
