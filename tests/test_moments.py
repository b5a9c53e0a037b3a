"""Running moments against least squares on the rows before each row."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from demandloom.operators import forecasting as FO
from demandloom.operators import moments as M


def test_solutions_equal_least_squares(spark):
    rnd = np.random.default_rng(2)
    rows = [(k, t, float(rnd.normal()), float(rnd.normal(5, 2)), float(rnd.normal(100, 9)) if rnd.random() > 0.1 else None) for k in range(20) for t in range(30)]
    df = spark.createDataFrame(rows, "k int, t int, a double, b double, y double")
    x = [F.lit(1.0), F.col("a"), F.col("b"), F.col("t").cast("double")]
    before = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    got = M.solved(M.with_moments(df, x, F.col("y"), F.col("y").isNotNull(), before), 4, [0.0, 1.0, 1.0, 1.0]).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [q for q in rows if q[0] == r.k and q[1] < r.t and q[4] is not None]
        assert r.rows == len(own)
        if len(own) >= 5:
            z = np.array([[1.0, q[2], q[3], q[1]] for q in own])
            w = np.linalg.solve(z.T @ z + np.diag([0.0, 1.0, 1.0, 1.0]), z.T @ np.array([q[4] for q in own]))
            assert [r.w_0, r.w_1, r.w_2, r.w_3] == pytest.approx(w, rel=1e-7, abs=1e-7)


def test_explained_columns_take_no_part(spark):
    df = spark.createDataFrame([(t, float(t), 2.0 * t, 3.0 + t) for t in range(10)], "t int, a double, b double, y double")
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    r = M.solved(M.with_moments(df, [F.lit(1.0), F.col("a"), F.col("b")], F.col("y"), F.lit(True), before), 3).filter("t = 9").first()
    assert (r.w_0, r.w_1, r.w_2) == pytest.approx((3.0, 1.0, 0.0), abs=1e-6)


def test_driver_forecast_of_short_equal_and_constant_series(spark):
    cal = spark.createDataFrame([(f"{y}-{m:02d}", 20.0 + (m % 3)) for y in range(1999, 2006) for m in range(1, 13)], "month string, working_days double")
    rnd = np.random.default_rng(4)
    long = (50 + np.arange(40) + 10 * np.sin(np.arange(40) * np.pi / 6) + rnd.normal(0, 1, 40)).tolist()
    rows = [("a", 24000, long), ("b", 24000, long), ("short", 24000, [1.0] * 17), ("flat", 24000, [4.0] * 18), ("none", 24000, [0.0] * 24)]
    df = spark.createDataFrame([(k, s, h, len(h)) for k, s, h in rows], "k string, start_ord int, h array<double>, n int")
    got = {r.k: r for r in FO.driver_forecast(df, cal, 3).collect()}
    assert set(got) == {"a", "b", "short", "flat", "none"}
    assert got["short"].driver_forecast is None and got["short"].driver_wape is None
    assert got["a"].driver_forecast == got["b"].driver_forecast and len(got["a"].driver_outer_pred) == 6
    assert got["flat"].driver_forecast == pytest.approx([4.0] * 3, abs=1e-6) and got["flat"].driver_wape == pytest.approx(0, abs=1e-6)
    assert got["none"].driver_wape is None and got["none"].driver_forecast == pytest.approx([0.0] * 3, abs=1e-9)
    days = np.array([20.0 + (((24000 + t) % 12 + 1) % 3) for t in range(43)])
    t = np.arange(43.0)
    ang = 2 * np.pi * ((24000 + t) % 12 + 1) / 12
    x = np.stack([np.ones(43), t, (days - np.mean([20.0 + m % 3 for m in range(1, 13)])) / np.mean([20.0 + m % 3 for m in range(1, 13)]), np.sin(ang), np.cos(ang)], 1)
    fit = lambda i, at: np.maximum(x[at] @ np.linalg.lstsq(x[:i], np.array(long)[:i], rcond=None)[0], 0)       # noqa: E731
    assert got["a"].driver_forecast == pytest.approx(fit(40, slice(40, 43)), rel=1e-6)
    assert got["a"].driver_outer_pred == pytest.approx([fit(i, i) for i in range(34, 40)], rel=1e-6)


def test_drivers_of_a_part(spark):
    rows = [("p", d, b, m, q) for d, b, m, q in (("2020-01-31", "B1", "M1", 10.0), ("2020-01-31", "B2", "M2", 5.0), ("2020-02-29", "B1", "M1", 4.0), ("2020-02-29", "B2", "M3", 9.0))]
    df = spark.createDataFrame(rows, "part_number string, sale_date string, brand string, model_name string, quantity double").withColumn("sale_date", F.to_date("sale_date"))
    r = FO.drivers(df).first()
    assert r.brand_drivers == "B1:-6.0; B2:+4.0" and r.model_drivers == "M3:+9.0; M1:-6.0; M2:-5.0"
