"""Immutable runs: one manifest, whoever writes."""

import os

import pytest

from demandloom.sources import sinks as SK


def tables(spark, n=5):
    return lambda: {"a": spark.range(n).withColumnRenamed("id", "x"), "b": spark.createDataFrame([(1, "p")], "k int, v string")}


def rows(found):
    return {t: sorted(map(tuple, df.collect())) for t, df in found.items()}


def test_a_run_is_built_once(spark, tmp_path):
    base, calls = f"file://{tmp_path}", []

    def build():
        calls.append(1)
        return tables(spark)()
    first, second = (rows(SK.get_or_create_run(spark, base, "r1", build, {"horizon": 3})) for _ in range(2))
    assert first == second == {"a": [(i,) for i in range(5)], "b": [(1, "p")]} and len(calls) == 1
    m = SK.manifest(spark, base, "r1")
    assert m["about"] == {"horizon": 3} and m["tables"]["a"]["rows"] == 5 and SK.attempts_left(spark, base, "r1") == []
    assert rows(SK.open_run(spark, base, "r1", verify=True)) == first and SK.open_run(spark, base, "other") is None


def test_a_killed_writer_leaves_no_run(spark, tmp_path):
    base = f"file://{tmp_path}"

    def dies():
        return tables(spark)() | {"c": spark.range(3).selectExpr("id", "assert_true(id < 1) AS boom")}
    with pytest.raises(Exception):          # noqa: B017
        SK.get_or_create_run(spark, base, "r1", dies)
    assert SK.open_run(spark, base, "r1") is None and len(SK.attempts_left(spark, base, "r1")) == 1
    assert len(rows(SK.get_or_create_run(spark, base, "r1", tables(spark)))) == 2        # the retry does not meet the leftovers
    assert len(SK.attempts_left(spark, base, "r1")) == 1


def test_two_writers_end_with_one_run(spark, tmp_path):
    base, other = f"file://{tmp_path}", []

    def slow():
        other.append(rows(SK.get_or_create_run(spark, base, "r1", tables(spark, 7))))    # another writer commits meanwhile
        return tables(spark, 5)()
    mine = rows(SK.get_or_create_run(spark, base, "r1", slow))
    assert mine == other[0] and len(mine["a"]) == 7 and SK.attempts_left(spark, base, "r1") == []


def test_an_unfinished_manifest_is_none(spark, tmp_path):
    base = f"file://{tmp_path}"
    SK.get_or_create_run(spark, base, "r1", tables(spark))
    path = tmp_path / "run_id=r1" / "manifest.json"
    whole = path.read_text()
    crc = tmp_path / "run_id=r1" / ".manifest.json.crc"
    if crc.exists():
        os.remove(crc)
    path.write_text(whole[:40])
    assert SK.manifest(spark, base, "r1") is None and SK.open_run(spark, base, "r1") is None
    assert len(rows(SK.get_or_create_run(spark, base, "r1", tables(spark, 2)))["a"]) == 2


def test_changed_content_is_noticed(spark, tmp_path):
    base = f"file://{tmp_path}"
    SK.get_or_create_run(spark, base, "r1", tables(spark))
    m = SK.manifest(spark, base, "r1")
    spark.range(9).withColumnRenamed("id", "x").write.mode("overwrite").parquet(f"{base}/run_id=r1/{m['attempt']}/a")
    with pytest.raises(ValueError, match="table a"):
        SK.open_run(spark, base, "r1", verify=True)


def test_export_rows_fill_missing_columns(spark):
    df = spark.createDataFrame([("B", "2020-01", 1.5)], "brand string, month string, value double")
    r = SK.export_rows("quantity", {"brand": df, "model": df.selectExpr("*", "'m' AS model_name", "0.5 AS share")}).collect()
    assert [tuple(x) for x in r] == [("quantity", "brand", "B", "", "", "", "2020-01", "", "", 1.5, None), ("quantity", "model", "B", "", "m", "", "2020-01", "", "", 1.5, 0.5)]
