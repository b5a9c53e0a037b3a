import numpy as np
import pandas as pd
import pytest

from demandloom.config import ANCHOR_METHODS
from demandloom.operators import challengers as CH
from demandloom.operators import forecasting as FO
from demandloom.operators import ml as ML
from demandloom.operators import smoothing as SM


def sample(origins=30, seed=0):
    """Examples of three anchors and three horizons with random features."""
    rng = np.random.default_rng(seed)
    month = lambda k: f"{2000 + k // 12:04d}-{k % 12 + 1:02d}"
    rows = [{"entity": e, "origin_month": month(o), "target_month": month(o + h), "horizon": h, "actual": 100 + 20 * rng.random(),
             "anchor": 100 + 20 * rng.random(), **{f"p_{m}": 100 + 20 * rng.random() for m in ML.ALTERNATIVES},
             **{f: rng.normal() for f in ML.feature_names()}} for o in range(origins) for h in (1, 2, 3) for e in ANCHOR_METHODS]
    d = pd.DataFrame(rows)
    return d.assign(residual=np.log1p(d["actual"]) - np.log1p(d["anchor"]))


def test_tree_by_hand():
    d = sample(4)
    d["actual"], d["anchor"] = 100.0, 110.0
    for m in ML.ALTERNATIVES:
        d[f"p_{m}"] = 110.0
    d["trend6"] = np.where(np.arange(len(d)) < 12, -1.0, 1.0)
    d["p_seasonal_naive"] = np.where(d["trend6"] < 0, 90.0, 130.0)     # blends go nearer to 100 on one side only, most at weight 0.7
    t = CH.fit_tree(d)
    assert ML.feature_names()[t["feature"]] == "trend6" and t["threshold"] == 0.0
    assert CH.POLICIES[t["left"]["policy"]][1:] == ("seasonal_naive", 0.7) and t["right"]["policy"] == 0
    assert np.allclose(CH.predict_tree(t, d), np.where(d["trend6"] < 0, 0.7 * 110 + 0.3 * 90, 110.0))
    assert CH.fit_tree(d.head(11))["cold"] and "feature" not in CH.fit_tree(d.head(11))


def test_small_gains_keep_the_anchor():
    d = sample(6)
    d["actual"], d["anchor"] = 100.0, 100.4
    for m in ML.ALTERNATIVES:
        d[f"p_{m}"] = 100.0
    assert CH.fit_tree(d)["policy"] == 0 and "feature" not in CH.fit_tree(d)


def test_elastic_solves_its_conditions():
    d = sample(20)
    d["residual"] = 0.1 * d["trend6"] + 0.01
    m = CH._descend(d, [(0.01, 0.5), (0.2, 0.5)], sweeps=500)
    w = d["actual"].to_numpy() / d["actual"].sum()
    z = (d[ML.feature_names()].to_numpy() - m["mean"]) / m["scale"]
    for beta, alpha in zip(m["beta"], (0.01, 0.2)):
        g = z.T @ (w * (d["residual"].to_numpy() - m["level"] - z @ beta)) - alpha * 0.5 * beta
        assert np.all(np.where(beta != 0, np.abs(g - alpha * 0.5 * np.sign(beta)), np.maximum(np.abs(g) - alpha * 0.5, 0)) < 1e-5)
    d["actual"] = np.expm1(np.log1p(d["anchor"]) + np.clip(0.3 * d["trend6"], -0.1, 0.1))
    d["residual"] = np.log1p(d["actual"]) - np.log1p(d["anchor"])
    fitted = CH.fit_elastic(d)
    assert fitted["clip"] > 0 and np.abs(CH.predict_elastic(fitted, d) / d["actual"] - 1).mean() < np.abs(d["anchor"] / d["actual"] - 1).mean() / 2
    assert CH.fit_elastic(d.head(17))["cold"] and CH.predict_elastic(CH.fit_elastic(d.head(17)), d).tolist() == d["anchor"].tolist()


def test_no_origin_sees_later_targets(spark):
    d = sample(16)
    run = lambda x: CH.nested_folds(spark.createDataFrame(x)).toPandas().set_index(["model_id", "entity", "origin_month", "horizon"])["prediction"].sort_index()
    before = run(d)
    late = d["target_month"] > "2000-12"
    after = run(d.assign(actual=np.where(late, d["actual"] * 5, d["actual"]), residual=np.where(late, 9.0, d["residual"])))
    known = before.index.get_level_values("origin_month") <= "2000-12"
    assert len(before) == 2 * len(d) and np.array_equal(before[known], after[known])


def test_smoothing_paths():
    from types import SimpleNamespace as NS
    t = np.arange(60)
    h = 1000 + 10.0 * t + 100 * np.sin(t * 2 * np.pi / 12)
    r = lambda **k: NS(**(dict(trend=True, damped=False, seasonal=True, init="estimated", bias=False, transform="raw", training_window="expanding", preprocessing="raw") | k))
    want = 1000 + 10.0 * np.arange(60, 63) + 100 * np.sin(np.arange(60, 63) * 2 * np.pi / 12)
    assert np.allclose(SM.candidate_paths(h, h, r(), [60], 3)[0][0], want, rtol=1e-3)
    many, _ = SM.candidate_paths(h, h, r(init="heuristic"), [24, 40, 60], 3)
    for k, o in enumerate((24, 40, 60)):                               # origins side by side give what each gives alone
        assert np.allclose(SM.candidate_paths(h[:o], h[:o], r(init="heuristic"), [o], 3)[0][0], many[k])
    noisy = h + np.random.default_rng(0).normal(0, 20, 60)
    inits = [SM.candidate_paths(noisy, noisy, r(init=i), [50], 3)[0][0] for i in SM.INITS]
    assert not np.allclose(inits[0], inits[1], atol=1e-9) and not np.allclose(inits[1], inits[2], atol=1e-9)
    bad, failed = SM.candidate_paths(h * 0, h, r(transform="boxcox"), [30], 3)
    assert np.isnan(bad).all() and failed[0].startswith("ValueError")


def test_strategies_raise(spark):
    p = spark.createDataFrame([("XX", 24000, [1.0] * 30, 30)], "entity string, start_ord int, h array<double>, n int")
    cal = spark.createDataFrame([("2000-01", 20.0)], "month string, working_days double")
    for name in ("reference_portfolio", CH.TREE, "no_such_strategy"):
        with pytest.raises(ValueError):
            FO.resolve(p, cal, strategy=name)
