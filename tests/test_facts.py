from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from demandloom.config import BasketPolicy
from demandloom.operators import facts as FA

SALES = "sale_date date, brand string, model_name string, model_code string, model_year string, part_number string, part_description string, plc string, quantity double, revenue decimal(18,4)"
WL = "month string, anchor_brand string, model_key string, brand string, model_name string, model_code string, wholesale_units double, fleet_units double"


def sale(d, brand="H", model="Car", qty=5.0, rev="50", part="P1", plc="Mats", year="2025", code="C1"):
    return (d, brand, model, code, year, part, "desc", plc, qty, Decimal(rev))


def test_fact_ratios(spark):
    s = spark.createDataFrame([sale(date(2025, 1, 3), qty=10.0, rev="100"), sale(date(2025, 1, 20), qty=5.0, rev="50"), sale(date(2025, 2, 1), qty=1.0, rev="9")], SALES)
    w = spark.createDataFrame([("2025-01", "HMA", "CAR", "HMA", "Car", "C1", 100.0, 0.0)], WL)
    cal = spark.createDataFrame([("2025-01", 20.0)], "month string, working_days double")
    rows = {r.month: r for r in FA.monthly_facts(s, w, cal).collect()}
    a = rows["2025-01"]
    assert len(rows) == 2 and (a.quantity, a.pnvw, a.units_per_vehicle, a.qty_per_working_day, a.source_rows) == (15.0, 1.5, 0.15, 0.75, 2)
    assert rows["2025-02"].pnvw is None and a.lifecycle_status == "Unknown"


def test_anchor_alias_and_fallback(spark):
    w = spark.createDataFrame([("2025-01", "GMA", "NOVA HYBRID", "G", "Nova Hybrid", "", 5.0, 0.0), ("2025-01", "HMA", "CAR", "H", "Car", "", 9.0, 0.0),
                               ("2025-01", "KUS", "CAR", "K", "Car", "", 2.0, 0.0)], WL)
    m = {r.model_key: (r.anchor_brand, r.method) for r in FA.anchor_map(w).collect()}
    assert m["CAR"] == ("HMA", "dealer_wholesale_volume_resolved") and m["NOVA HEV"] == ("GMA", "dealer_wholesale_variant_alias")
    d = spark.createDataFrame([("H", "NOVA"), ("K", "OTHER"), ("H", "G80 X"), ("H", "ZZZ")], "brand string, model_key string")
    got = {r.model_key: r.anchor_method for r in FA.assign_anchor(d, FA.anchor_map(w)).collect()}
    assert got == {"NOVA": "dealer_wholesale_variant_alias", "OTHER": "source_brand_kus", "G80 X": "genesis_name_fallback", "ZZZ": "hma_default_fallback"}


def test_baskets(spark):
    f = "month string, anchor_brand string, model_year string, plc string, quantity double, revenue decimal(18,4)"
    facts = spark.createDataFrame([("2026-05", "KUS", "2027", "Carpet Floor Mat", 100.0, Decimal(10000)), ("2026-06", "KUS", "2027", "carpet floor mat", 100.0, Decimal(10000)),
                                   ("2026-06", "KUS", "2026", "Other", 50.0, Decimal(6000))], f)
    w = spark.createDataFrame([("2026-06", "KUS", "CAR", "K", "Car", "", 200.0, 60.0)], WL)
    r = {x.month: x for x in FA.channel_baskets(facts, w, BasketPolicy()).collect()}
    assert r["2026-05"].fleet_revenue == 0 and r["2026-05"].contract_mode == "legacy_wholesale_only"
    assert (r["2026-06"].fleet_quantity, r["2026-06"].fleet_revenue, r["2026-06"].wholesale_revenue, r["2026-06"].status) == (60.0, 6000.0, 10000.0, "pass")


def test_lifecycle_states(spark):
    rows = [("A", y, m) for y in (2023, 2024, 2025) for m in range(1, 13)] + [("A", 2026, m) for m in range(1, 8)] + [("Old", 2023, 5), ("Back", 2023, 1), ("Back", 2025, 7), ("Back", 2026, 7), ("New", 2026, 3), ("New", 2026, 7),
                                                                                                            ("Gone", 2025, 8)]
    s = spark.createDataFrame([sale(date(y, m, 5), model=n) for n, y, m in rows], SALES)
    got = {r.model_name: (r.status_code, r.reintroduced_month) for r in FA.lifecycle(s).collect()}
    assert got == {"A": ("active", None), "Old": ("discontinued", None), "Back": ("reintroduced", "2025-07"), "New": ("new", None), "Gone": ("inactive", None)}
