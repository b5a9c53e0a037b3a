from datetime import date, datetime

import pytest

from pyspark.sql import functions as F

from demandloom.config import ROLE_PATTERNS
from demandloom.functions import dates as D
from demandloom.sources import roles as RO


def found(spark, **sources):
    return RO.roles(RO.column_facts(sources))


def test_names_dates_and_numbers_decide(spark):
    rows = [(date(2024, m, 3), f"2024-{m:02d}-15", "Alpha", 20240100 + m, float(m), str(m), m * 10.0) for m in range(1, 9)]
    df = spark.createDataFrame(rows, "`Invoice Date` date, `Date_text` string, `vehicle model` string, `when` int, `Qty` double, `sold units` string, `Sales Revenue` double")
    got = {r.role: (r.column, r.score, r.date_candidate) for r in found(spark, s=df).collect()}
    assert got["date"] == ("Invoice Date", 2 + 4, True)               # ends with 'date'; holds dates of its own type
    assert got["model"] == ("vehicle model", 2 + 4, False)             # ends with 'model' and is a pattern
    assert got["installation_quantity"][:2] == ("Qty", 4 + 1)          # exact and numeric, against text that ends with 'units'
    assert got["revenue"][0] == "Sales Revenue" and "plc" not in got


def test_first_of_equals_and_fallback_date(spark):
    rows = [(datetime(2023, 1 + i, 1 + i), "x", float(i), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "moment timestamp, a string, `qty one` double, `qty two` double")
    got = {r.role: (r.column, r.score) for r in found(spark, s=df).collect()}
    assert got["date"] == ("moment", 4)                                  # by what it holds
    assert got["installation_quantity"] == ("qty one", 2)
    text = spark.createDataFrame([(f"2023-{i:02d}-0{i}", "z") for i in range(1, 9)], "stamp string, a string")
    assert {r.role: (r.column, r.score) for r in found(spark, s=text).collect()}["date"] == ("stamp", 2)
    none = {k: v for k, v in ROLE_PATTERNS.items() if k != "date"}
    assert {r.role: (r.column, r.score) for r in RO.roles(RO.column_facts({"s": text}), none).collect()} == {"date": ("stamp", 0)}


def test_few_or_equal_dates_are_no_candidate(spark):
    df = spark.createDataFrame([("2023-01-01", None, "2023-01-01")] * 3 + [("2023-01-01", "2024-05-06", "x")] * 5, "same_date string, sparse_date string, mixed string")
    facts = {r.column: (r.dates, r.date_candidate) for r in RO.column_facts({"s": df}).collect()}
    assert facts == {"same_date": (8, False), "sparse_date": (5, False), "mixed": (3, False)}
    assert [r.rows for r in RO.column_facts({"e": df.limit(0)}).collect()] == [0, 0, 0]


def test_choice_of_a_source(spark):
    dates = [(date(2024, m, 1), "m", 1.0, 2.0) for m in range(1, 7)]
    full = spark.createDataFrame(dates, "month date, model string, qty double, revenue double")
    part = full.drop("revenue")
    nodate = spark.createDataFrame([("a", "m", 1.0, 2.0)], "date string, model string, qty double, revenue double")
    f = found(spark, part=part, nodate=nodate, one=full, two=full)
    names = ["part", "nodate", "one", "two"]
    assert RO.choose(f, names) == "one" and RO.choose(f, names, requested="two") == "two" and RO.choose(f, names, requested="part") == "one"
    assert RO.choose(f, names, requested="one", canonical="PART") == "part" and RO.choose(f, names, requested="unknown") == "one"
    assert {r.source: (r.held, r.missing, r.complete) for r in RO.holding(f, names).collect()} == {
        "part": (3, "revenue", False), "nodate": (3, "date", False), "one": (4, "", True), "two": (4, "", True)}
    with pytest.raises(ValueError, match="part lacks revenue; nodate lacks date"):
        RO.choose(f, ["part", "nodate"])
    assert RO.named(["Wholesale A", "x", "b wholesale"], "wholesale") == ["Wholesale A", "b wholesale"]
    assert RO.as_roles(f, "one").quantity == "qty" and RO.as_roles(f, "one").brand == "brand"


def test_cells_are_read_as_their_text_is(spark):
    """Numbers are not made text first; each cell gives the date that its text gives."""
    numbers = [0.0, 1899.0, 1900.0, 1999.5, 2100.0, 2101.0, 19999.0, 20000.0, 45000.0, 80000.0, 80001.0, 199900.0, 199912.0, 199913.0, 19990229.0, 20000229.0, 19991231.0, 1e30, -2000.0, float("nan"), float("inf"), None]
    texts = ["1999-01-31", "1999-02-30", " 2000 ", "31 Jan 1999", "Jan 1999", "NaN", "nothing", "Infinity", "1e3", "2e3", "\t2001", ".5", "-1", "+2002", "12/31/1999", "1234 bolts", "x19990101", "", " ", "1999-01-31 10:00:00", None, "20d"]
    whole = [None if x is None or x != x or abs(x) > 1e18 else int(x) for x in numbers]
    df = spark.createDataFrame(list(zip(numbers, whole, texts, numbers, strict=True)), "d double, l long, t string, f float")
    want = [sum(r.x is not None for r in df.filter(F.coalesce(F.abs(c) < 1e18, F.lit(True)) if c != "t" else F.lit(True)).select(D.mixed_date(F.col(c)).alias("x")).collect()) for c in df.columns]
    got = {r.column: r.dates for r in RO.column_facts({"s": df}).collect()}
    assert [got[c] for c in df.columns] == want == [8, 9, 9, 8]
