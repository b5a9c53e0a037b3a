"""The forecast center's cube on hand-made leaves."""

from demandloom.operators import center as CC


def test_levels_add_up_and_leaves_follow_the_nowcast(spark):
    leaf = "brand string, entity_key string, model_name string, plc string, month string, value double"
    actual = spark.createDataFrame([("A", "A::m", "m", "x", "2020-01", 4.0), ("B", "B::n", "n", "x", "2020-01", 6.0)], leaf)
    ahead = spark.createDataFrame([("A", "A::m", "m", "x", "2020-02", 30.0), ("A", "A::m", "m", "y", "2020-02", 10.0), ("B", "B::n", "n", "x", "2020-02", 5.0), ("C", "C::o", "o", "y", "2020-02", 1.0)], leaf)
    now = spark.createDataFrame([("A", "2020-02", 40.0, 60.0, "Nowcast"), ("B", "2020-02", 5.0, 5.0, "Nowcast")], "brand string, month string, baseline double, value double, forecast_type string")
    bounds = spark.createDataFrame([("A", "2020-02", 48.0, 80.0, "validated"), ("B", "2020-02", 6.0, 4.0, "unvalidated_insufficient_residuals")], "brand string, month string, lower double, upper double, status string")
    got = {(r.surface, r.level, r.brand, r.model_name, r.plc): (r.value, r.lower, r.upper, r.validated, r.leaves) for r in CC.cube(actual, ahead, now, bounds).collect()}
    assert got["actual", "total", "", "", ""] == (10.0, None, None, None, 2) and got["actual", "plc", "", "", "x"][0] == 10.0
    assert got["nowcast", "brand", "A", "", ""] == (60.0, 48.0, 80.0, True, 2)                  # 40 became 60, the leaves with it
    assert got["nowcast", "model_plc", "A", "m", "x"] == (45.0, 36.0, 60.0, True, 1)
    assert got["nowcast", "brand", "B", "", ""] == (5.0, 5.0, 5.0, False, 1)                     # bounds never cut into the value
    assert got["nowcast", "total", "", "", ""] == (65.0, 53.0, 85.0, False, 3)
    assert got["forecast", "brand", "C", "", ""] == (1.0, 1.0, 1.0, False, 1)                    # no forecast row: left as it is
    assert {k[1] for k in got} == set(CC.LEVELS)
    empty = CC.cube(actual.limit(0), ahead.limit(0), now, bounds)
    assert empty.filter("level <> 'total'").count() == 0
