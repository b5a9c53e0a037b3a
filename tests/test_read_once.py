"""Queries that read an anchor's folds several times read the sales once."""

import pytest
from pyspark.sql import functions as F

from demandloom.plans import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three parts, one for each anchor, sold in every month."""
    path = str(tmp_path_factory.mktemp("sales"))
    n = spark.range(3 * 82)
    day = F.expr("timestampadd(MONTH, cast(id div 3 as int), timestamp '1995-01-10 00:00:00')")
    spark.createDataFrame([(i, f"small bolt {i}", f"Brand#{i + 3}", "LARGE") for i in range(3)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{path}/part.parquet")
    n.select(F.col("id").alias("o_orderkey"), day.alias("o_orderdate")).write.parquet(f"{path}/orders.parquet")
    n.select(F.col("id").alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"), (F.col("id") % 7 + 10.0).alias("l_quantity"), (F.col("id") % 11 + 100.0).alias("l_extendedprice"),
             F.lit(0.1).alias("l_discount"), F.lit("O").alias("l_linestatus"), day.alias("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["E12_promotion_gate", "E13_evaluation_scopes", "FC27_governed_total"])
def test_sales_are_not_in_the_final_plan(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert "l_partkey" not in df._jdf.queryExecution().toString()
    rows = df.collect()
    assert len(rows) == (5 if name.startswith("E12") else 2)
    if not name.startswith("E12"):
        assert {r.scope: r.fold_count for r in rows} == {"entity_rows": 3 * 171, "common_origin_total": 171}


def test_profiles_make_no_column_that_they_do_not_need(spark, folder):
    df = QUERIES["A26_exception_profiles"](spark, folder)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "mode(part_description" not in plan and "l_partkey" in plan
    assert {r.scope: r["n"] for r in df.groupBy("scope").agg(F.count("*").alias("n")).collect()} == {"Model": 3, "PLC": 3, "PIS_PNO": 3}


def test_rules_on_exceptions_read_one_stored_profile(spark, folder):
    for name in ("E8_exceptions", "E8_revenue_exceptions"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "mode(" not in plan and "min(o" not in plan


def test_quality_rollup_and_bundle_need_fewer_readings(spark, folder, monkeypatch):
    from demandloom.plans import hierarchy as PH
    made, facts = [], PH.governed_facts
    monkeypatch.setattr(PH, "governed_facts", lambda *a: made.append(1) or facts(*a))
    assert {r.check: r.status for r in QUERIES["A30_quality_rollup"](spark, folder).collect()} == dict.fromkeys(("revenue", "quantity", "wholesale", "MODEL_STATUS"), "PASS")
    assert len(made) == 1
    stats, built = PH.HI.part_stats, []
    monkeypatch.setattr(PH.HI, "part_stats", lambda *a, **k: built.append(1) or stats(*a, **k))
    assert QUERIES["H13_J15_A30_part_bundle"](spark, folder).count() and len(built) == 1


def test_facts_are_not_made_again_for_each_section_or_step(spark, folder):
    assert "o_orderdate" not in QUERIES["H11_evaluation_report"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in QUERIES["FC28_hierarchical_part"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_many_rows_are_not_sent_to_every_task(spark, folder, monkeypatch):
    from demandloom.plans import inputs as I
    from demandloom.sources import planning as P
    plan = lambda: I.anchored_sales(spark, folder).unionByName(I.anchored_sales(spark, folder))._jdf.queryExecution().sparkPlan().toString() + I.sales(      # noqa: E731
        spark, folder, model_year=True)._jdf.queryExecution().sparkPlan().toString()
    rows = I.anchored_sales(spark, folder).collect()
    monkeypatch.setattr(P, "SENT_ROWS", 2)
    made = plan()
    assert not [line for line in made.splitlines() if "BroadcastHashJoin" in line and ("partkey" in line or "orderkey" in line)] and "SortMergeJoin" in made
    assert sorted(map(str, I.anchored_sales(spark, folder).collect())) == sorted(map(str, rows)) and len(rows) == 3 * 82


def test_promotion_gate_makes_its_series_once(spark, folder, monkeypatch):
    from demandloom.plans import evaluate, govern
    made, series = [], evaluate.anchor_series
    for module in (evaluate, govern):
        monkeypatch.setattr(module, "anchor_series", lambda *a: made.append(1) or series(*a))
    assert {r.check: r.passed for r in QUERIES["E12_promotion_gate"](spark, folder).collect()}["same_folds"] and len(made) == 1
