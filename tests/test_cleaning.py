from datetime import date

import numpy as np
from pyspark.sql import functions as F

from demandloom.functions import dates as D
from demandloom.functions import text as T
from demandloom.operators import explore as X
from demandloom.sources import sheets as SH


def test_mixed_dates(spark):
    vals = ["2023-01-01 00:00:00", "2024-02-03", "46195", "202505", "20250607", "2026/06/08", "0001-01-01", None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string").orderBy("i").select(D.mixed_date(F.col("v"))).collect()]
    assert got == [date(2023, 1, 1), date(2024, 2, 3), date(2026, 6, 22), date(2025, 5, 1), date(2025, 6, 7), date(2026, 6, 8), None, None]


def test_weekdays_and_completion(spark):
    r = spark.sql("select date'2026-07-01' a, date'2026-07-28' b, date'2026-07-31' e").select(
        D.weekdays(F.col("a"), F.col("b")), D.weekdays(F.col("a"), F.col("e")), D.month_completion(F.col("e"))).first()
    assert tuple(r) == (20, 23, 1.0)


def cells(spark, grid, sheet="s"):
    return spark.createDataFrame([(sheet, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None], "sheet string, r long, c int, v string")


def test_header_two_rows_keeps_first_vehicle(spark):
    months = ["January", "February", "March", "April", "May", "June"]
    grid = [["Brand", "2023 Wholesale"] + [None] * 6, [None, "Model", *months], ["A", "Car 1", *"123456"], [None, "Car 2", *"234567"]]
    plan = SH.header_plan(cells(spark, grid))
    rows = plan.collect()
    assert {(r.header_row, r.header_depth) for r in rows} == {(0, 2)}
    assert SH.data_cells(cells(spark, grid), plan).filter("v = 'Car 1'").count() == 1


def test_header_by_known_names(spark):
    grid = [["PIS_SERI", "PIS_PNO", "Model", "Qty"], ["a", "1", "m", "-1"], ["b", "2", "n", "3"]]
    plan = SH.header_plan(cells(spark, grid))
    assert {(r.header_row, r.header_depth) for r in plan.collect()} == {(0, 1)}
    data = SH.data_cells(cells(spark, grid), plan)
    typed = SH.typed_cells(data, SH.column_types(data))
    assert sorted(r.number for r in typed.filter("name = 'Qty'").collect()) == [0.0, 3.0]


def test_header_prefix_duplicates_and_score(spark):
    # best score, ties to the upper header: the title is a shared prefix and goes, a repeated name is numbered, blank columns drop out
    grid = [["Plan", None, None, None, None], ["Item", "Qty", "Qty", "Unnamed: 3", "Note"], *[[f"i{k}", str(k), str(k + 1), None, "x"] for k in range(4)]]
    plan = sorted(SH.header_plan(cells(spark, grid)).collect(), key=lambda r: r.c)
    assert {(r.header_row, r.header_depth, r.last_header_r) for r in plan} == {(0, 2, 1)}
    assert [(r.c, r.name) for r in plan] == [(0, "Item"), (1, "Qty"), (2, "Qty (2)"), (4, "Note")]
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun"]
    two = cells(spark, [["Units", *[None] * 6], ["Model", *months], ["a", *"123456"]], "two").union(cells(spark, [["only", "row"]], "one")).union(
        cells(spark, [["Base", "Units", *[None] * 6], ["Base", "Model", *months], ["a", "b", *"123456"]], "most"))
    got = {}
    for r in SH.header_plan(two).collect():
        got.setdefault(r.sheet, {})[r.c] = (r.header_row, r.header_depth, r.name)
    assert got["two"] == {i: (0, 2, n) for i, n in enumerate(["Model", *months])} and "one" not in got
    assert got["most"] == {i: (0, 2, n) for i, n in enumerate(["Base", "Model", *months])}


def test_unpivot_years_from_latest_sales_year(spark):
    grid = [["Brand", "Model", "Model Code", "Jan", "Feb", "Jan", "Feb"], ["HMA", "Car 1", "C1", "1", "2", "3", "-1"], [None, "Car 2", "C2", "5", "6", "7", "8"]]
    plan = spark.createDataFrame([("s", i, n, 0) for i, n in enumerate(["Brand", "Model", "Model Code", "Jan", "Feb", "Jan (2)", "Feb (2)"])],
                                 "sheet string, c int, name string, last_header_r int")
    u = SH.unpivot_months(SH.data_cells(cells(spark, grid), plan), latest_sales_year=2026).collect()
    assert {r.month for r in u} == {"2025-01", "2025-02", "2026-01", "2026-02"}
    assert [r.units for r in u if r.model_name == "Car 1" and r.month == "2026-02"] == [0.0]
    assert {r.brand for r in u} == {"HMA"}


def test_unpivot_markers_and_totals(spark):
    grid = [["Brand", "Model", "Jan"], ["HMA", "A", "100"], [None, "B", "250"], ["HMA Total", "Total", "350"], ["Fleet", None, None], ["HMA", "A", "999"], [None, "B", "999"]]
    plan = spark.createDataFrame([("sheet 2025", i, n, 0) for i, n in enumerate(grid[0])], "sheet string, c int, name string, last_header_r int")
    data = SH.data_cells(cells(spark, grid, "sheet 2025"), plan)
    got = {r.channel: r.s for r in SH.unpivot_months(data).groupBy("channel").agg(F.sum("units").alias("s")).collect()}
    assert got == {"wholesale": 350.0, "fleet": 1998.0}


def test_forward_fill_across_chunks(spark):
    rows = [("a", i, "x" if i == 3 else "y" if i == 25 else None) for i in range(60)] + [("b", i, None) for i in range(5)]
    got = SH.forward_fill(spark.createDataFrame(rows, "p string, r long, v string"), ["p"], "r", "v", "f").collect()
    want = lambda p, i: None if p == "b" or i < 3 else "x" if i < 25 else "y"
    assert all(r.f == want(r.p, r.r) for r in got) and len(got) == 65


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.round(np.concatenate([rng.normal(0, 50, 400), np.full(300, 7.0), [0.0, -1e6, 1e6]]), 3)
    df = spark.createDataFrame([("g", float(x)) for x in v] + [("h", 5.0)], "g string, v double")
    got = {r.g: r for r in X.exact_percentiles(df, "v", [0.01, 0.5, 0.99], ["g"]).collect()}
    assert np.allclose([got["g"].q0, got["g"].q1, got["g"].q2], np.quantile(v, [0.01, 0.5, 0.99]))
    assert got["h"].q1 == 5.0


def test_aliases_and_years(spark):
    r = spark.range(1).select(T.model_aliases(F.lit("Alpha Plug-In Hybrid")), T.model_aliases(F.lit("Beta EV")), T.model_year(F.lit("2027.0")), T.model_year(F.lit("x 2031 y")), T.model_year(F.lit("3000"))).first()
    assert set(r[0]) == {"ALPHA PLUG-IN HYBRID", "ALPHA PHEV", "ALPHA"} and set(r[1]) == {"BETA EV", "BETA"} and tuple(r[2:]) == ("2027", "2031", "")
