import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.config import BASELINE_MODELS, BacktestContract
from demandloom.functions import forecast as FC
from demandloom.operators import evaluate as EV
from demandloom.operators import forecasting as FO
from demandloom.operators import smoothing as SM
from demandloom.operators import report as R
from demandloom.operators import series as S


def packed(spark, h, entity="E", start=2022 * 12):
    return spark.createDataFrame([(entity, start, [float(x) for x in h], len(h))], "entity string, start_ord int, h array<double>, n int")


def path(spark, h, model, k=3):
    return packed(spark, h).select(FC.path(F.col("h"), model, k)).first()[0]


def test_hand_computed_baselines(spark):
    h = [10, 20, 30, 40]
    assert path(spark, h, "naive_last") == [40, 40, 40]
    assert path(spark, h, "mean", 1) == [25.0]
    assert path(spark, h, "weighted_moving_average", 1) == pytest.approx([40 * .6 + 30 * .3 + 20 * .1])
    assert path(spark, list(range(1, 25)), "seasonal_mean", 1) == [(13 + 1) / 2]
    assert path(spark, [0, 0, 5, 0, 0], "croston_sba", 1) == pytest.approx([0 * .6 + 0 * .3 + 5 * .1])
    assert path(spark, [], "mean") == [0, 0, 0]


@pytest.mark.parametrize("model", [m[0] for m in BASELINE_MODELS])
def test_never_negative(spark, model):
    rng = np.random.default_rng(3)
    assert min(path(spark, np.maximum(rng.normal(20, 30, 40), 0), model)) >= 0


def test_fold_counts(spark):
    f = EV.folds(packed(spark, range(100, 142)), ["entity"], "naive_last")
    got = {r.horizon: r["count"] for r in f.groupBy("horizon").count().collect()}
    assert got == {1: 18, 2: 17, 3: 16} and BacktestContract().expected_counts(42)["combined"] == 51
    assert f.filter("target_month <= origin_month").count() == 0


def test_failed_folds_are_kept(spark):
    def bad(history, horizon):
        if horizon == 2:
            raise RuntimeError("boom")
        return history[-1], "x"
    f = EV.folds_with(packed(spark, range(27)), ["entity"], bad)
    assert f.filter("prediction is null").count() == 2 and f.filter("error like 'RuntimeError%'").count() == 2
    a = EV.audit(f, BacktestContract().expected_counts(27), ["E"]).first()
    assert a.status == "fail" and a.missing_predictions == 2


def test_intervals(spark):
    r = spark.createDataFrame([("E", 1, f"20{24 + i // 12}-{i % 12 + 1:02d}", f"o{i:02d}", 100.0, 102.0) for i in range(18)],
                              "entity string, horizon int, target_month string, origin_month string, actual double, prediction double")
    p = spark.createDataFrame([("E", 1, "2026-07", 120.0)], "entity string, horizon int, month string, point double")
    x = EV.intervals(p, r, ["entity"]).first()
    assert (x.lower, x.point, x.upper, x.residual_count, x.empirical_coverage) == (118.0, 120.0, 122.0, 18, 1.0)


def test_higher_quantile_equals_numpy(spark):
    for n in (1, 2, 9, 10, 11, 57):
        v = sorted(np.random.default_rng(n).random(n).tolist())
        got = packed(spark, v).select(EV.higher_quantile(F.col("h"), 0.9)).first()[0]
        assert got == np.quantile(v, 0.9, method="higher")


def test_driver_regression_recovers_trend(spark):
    cal = spark.createDataFrame([(f"{y}-{m:02d}", 20.0 + m % 3) for y in range(2022, 2027) for m in range(1, 13)], "month string, working_days double")
    h = [100 + 2 * i + 10 * np.sin(2 * np.pi * (i % 12 + 1) / 12) for i in range(36)]
    d = FO.driver_forecast(packed(spark, h), cal, 3)
    r = d.first()
    assert r.driver_coef[1] == pytest.approx(2.0, abs=1e-3) and r.driver_wape < 1e-6
    assert {x.name for x in FO.coefficient_rows(d, ["entity"]).collect()} >= {"seasonal_amplitude", "working_day_effect"}


def test_grid_keeps_every_fold(spark):
    g = SM.candidate_grid(spark, structures=SM.STRUCTURES[:1], inits=("heuristic",), windows=("expanding",), preprocessing=("raw",))
    f = SM.grid_folds(packed(spark, [0.0] + [10.0 + i for i in range(29)]), g)
    per = f.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).collect()
    assert {r.n for r in per} == {15} and all((r.bad == 15) == ("boxcox" in r.model_id) for r in per)
    assert SM.candidate_grid(spark).count() == 1080


def test_champion_tie_band(spark):
    m = spark.createDataFrame([("ets_additive", .100, .02, .1, 1.0, 5), ("naive_last", .104, .01, .1, 1.0, 5), ("mean", .2, 0.0, .1, 1.0, 5)],
                              "model string, wape double, bias_pct double, fold_std double, coverage double, fold_count int")
    assert EV.champion(m).first().champion == "naive_last"


def test_pack_fills_gaps_and_clips(spark):
    d = spark.createDataFrame([("a", "2024-01", 3.0), ("a", "2024-03", -1.0), ("a", "2024-03", 4.0), ("a", "2024-04", 1.0)], "k string, month string, v double")
    assert S.pack(d, ["k"], F.col("v")).first().h == [3.0, 0.0, 4.0, 1.0]


def test_movers(spark):
    pts = [("A", "x", "2026-01", 10.0), ("A", "y", "2026-01", 20.0), ("A", "z", "2026-01", 5.0), ("A", "x", "2026-02", 16.0), ("A", "y", "2026-02", 11.0), ("A", "n", "2026-02", 1.0)]
    m = R.actual_movers(spark.createDataFrame(pts, "brand string, plc string, month string, revenue double")).collect()
    assert {(r.plc, r.direction, r.rank, r.change) for r in m} == {("x", "upside", 1, 6.0), ("y", "downside", 1, -9.0)}
