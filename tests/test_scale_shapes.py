"""Operators whose tasks stay small when one key, bucket or sheet holds most of the rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import explore as X
from demandloom.sources import sheets as S


@pytest.mark.parametrize("most", [50, 100_000])
def test_percentiles_where_one_band_holds_nearly_all(spark, monkeypatch, most):
    rnd = np.random.default_rng(1)
    band = 100 + rnd.random(9000)                                                 # one bucket: they differ by 1 %
    close = 7.0 + np.arange(700) * 2.0 ** -50                                      # neighbouring doubles
    values = np.concatenate([band, close, rnd.normal(0, 50, 500), np.full(300, 100.5), [0.0, -0.0, 1e-310, 1e300, -1e300, 5e-324]])
    qs = [0.0, 0.01, 0.07, 0.5, 0.9, 0.99, 1.0]
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in (values if g == "a" else -values[:50])] + [("a", None)], "g string, v double")
    counts = X.value_counts(df, "v", ["g"])
    found = X.rank_buckets(counts, qs, ["g"], most)
    assert found.filter((F.col("m") > most) & (F.col("lo") < F.col("hi"))).count() == 0
    for sent in (0, 10_000):
        monkeypatch.setattr(X, "MOST_SENT", sent)
        got = {r.g: r for r in X.percentiles_of(counts, qs, ["g"], most).collect()}
        for g, own in (("a", values), ("b", -values[:50])):
            assert got[g].n_values == len(own)
            np.testing.assert_allclose([got[g][f"q{i}"] for i in range(len(qs))], np.percentile(own, np.array(qs) * 100), rtol=1e-13)
    all_of = X.percentiles_of(X.value_counts(df, "v"), [0.5], most=most).first()
    np.testing.assert_allclose(all_of.q0, np.median(np.concatenate([values, -values[:50]])), rtol=1e-13)


def test_percentiles_of_nothing_and_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (3.0,)], "v double")
    assert X.exact_percentiles(df, "v", [0.5]).first().q0 == 2.0
    assert X.exact_percentiles(df.filter("v > 9 and v < 8"), "v", [0.5]).first() in (None, (None, None))


def slowly(rows):
    last, out = {}, []
    for sheet, r, v in sorted(rows, key=lambda x: x[:2]):
        last[sheet] = v if v is not None else last.get(sheet)
        out.append((sheet, r, last[sheet]))
    return out


def test_carry_of_long_and_of_sparse_sheets(spark):
    rows = [("long", i, f"v{i}" if i % 7001 == 5 else None) for i in range(20_000)]
    rows += [("sparse", i * 10 ** 9, f"s{i}" if i % 50 == 3 else None) for i in range(500)] + [("none", i, None) for i in range(300)] + [("one", 5, "x")]
    df = spark.createDataFrame(rows, "sheet string, r bigint, v string").repartition(6)
    assert sorted(map(tuple, S.forward_fill(df, ["sheet"], "r", "v", "w").select("sheet", "r", "w").collect())) == slowly(rows)


def test_carry_of_a_million_rows_needs_no_window_over_the_sheet(spark):
    df = spark.range(1_000_000).select(F.lit("s").alias("sheet"), F.col("id").alias("r"), F.when(F.col("id") % 400_000 == 7, F.col("id").cast("string")).alias("v"))
    out = S.forward_fill(df, ["sheet"], "r", "v", "w")
    specs = re.findall(r"windowspecdefinition\(([^)]*)", out._jdf.queryExecution().optimizedPlan().toString())
    assert specs and all("__p" in x for x in specs)
    got = out.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo")).orderBy("lo").collect()
    assert [(r.w, r.n, r.lo) for r in got] == [(None, 7, 0), ("7", 400_000, 7), ("400007", 400_000, 400_007), ("800007", 199_993, 800_007)]
    assert df.limit(0).count() == 0 and S.forward_fill(df.limit(0), ["sheet"], "r", "v", "w").count() == 0


def test_long_form_is_dealt_by_its_rows(spark):
    """Tasks of a windowed long form grow with the rows; the packed rows are dealt and nothing is shuffled after that."""
    from demandloom.operators import series as SE
    packed = spark.range(200).select(F.col("id").cast("string").alias("part_number"), F.lit(23940).alias("start_ord"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i * 1.0).alias("h"))
    held = SE.dealt(packed, ["part_number"], most=500)
    assert held.rdd.getNumPartitions() == 20
    out = SE.recent_signals(SE.unpack(held, ["part_number"]), ["part_number"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert out.count() == 200 * 50 and out.agg(F.max("history")).first()[0] == 1275.0


def test_months_of_levels_keep_the_code_of_most_facts(spark):
    from demandloom.operators import hierarchy as HI
    rows = [("a", "p", "2001-01", c, q) for c, q in [("new", 1.0), ("new", 2.0), ("active", 9.0), (" ", 1.0), (None, 1.0), (None, -5.0)]]
    rows += [("a", "p", "2001-02", c, 1.0) for c in ("new", "active")] + [("a", "r", "2001-02", None, None), (None, "r", "2001-02", "nan", 2.0)]
    f = spark.createDataFrame(rows, "brand string, plc string, month string, lifecycle_code string, quantity double").withColumn("revenue", F.col("quantity") * 2)
    for keys in (["brand"], ["brand", "plc"]):
        got = [sorted(map(str, HI.month_totals(df, keys).collect())) for df in (f, HI.level_months(f, ["brand", "plc"]))]
        assert got[0] == got[1]
    assert {r.o % 12: (r.q, r.code) for r in HI.month_totals(HI.level_months(f, ["brand", "plc"]), ["brand"]).filter("brand is not null").collect()} == {0: (14.0, "new"), 1: (2.0, "active")}


def test_fact_summary_sorts_no_multiplied_rows(spark):
    from demandloom.operators import facts as FA
    rows = [("2001-01", "b", "H", "dealer_wholesale_exact", "e1", "x", "1", 2.0, 10.0, 1.0, None), ("2001-02", "b", "H", "hma_default_fallback", "e2", None, "1", 6.0, 5.0, None, 20.0),
            (None, None, None, None, None, None, None, None, None, None, None)]
    f = spark.createDataFrame(rows, "month string, brand string, anchor_brand string, anchor_method string, entity_key string, plc string, part_number string, quantity double, "
                                    "revenue double, wholesale_units double, working_days double")
    df = FA.fact_summary(f)
    assert not re.search(r"SortAggregate\(key=\[[^\]]", df._jdf.queryExecution().executedPlan().toString())
    assert tuple(df.first()) == (3, 2, "2001-01", "2001-02", 1, 1, 2, 1, 1, 8.0, 15.0, 25.0, 33.33, 33.33)
    assert tuple(FA.fact_summary(f.limit(0)).first()) == (0, 0, None, None, 0, 0, 0, 0, 0, None, None, 0.0, None, None)


def test_column_facts_shuffle_dates_but_no_texts(spark):
    from demandloom.sources import roles as RO
    df = spark.range(300).select(F.concat(F.lit("no "), "id").alias("name"), F.expr("date_add(date'1899-12-25', cast(id as int))").alias("day"), F.lit("2001-02-03").alias("text"))
    out = RO.column_facts({"s": df})
    assert not re.search(r"hashpartitioning\([^)]*\bv#", out._jdf.queryExecution().executedPlan().toString())
    assert {r.column: (r.rows, r.dates, r.date_candidate) for r in out.collect()} == {"name": (300, 0, False), "day": (300, 293, True), "text": (300, 300, False)}
