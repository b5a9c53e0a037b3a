import duckdb
import pytest

import __spark_entry__ as E

PATH = "/root/testdata/sf0.001"
SAMPLE = ["A1_monthly_facts", "A20_pivot_sum", "A22_facet_options", "J5_monthly_full_outer", "W2_anomalies", "FC13_FC14_model_selection", "E4_R8_portfolio_total",
          "H2_H3_H4_model_allocation", "V1_J14_W12_actual_movers", "X1_ranked_context"]


def test_catalogue():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 150


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    df = E.queries()[name](spark, PATH)
    cols = sorted(df.columns)
    rel = con.execute(E.oracle_sql()[name])
    oc = [d[0] for d in rel.description]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((tuple(r[oc.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert sorted(oc) == cols and len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and a == pytest.approx(b, rel=1e-6, abs=1e-4)) for a, b in zip(g, w, strict=True)), (g, w)
