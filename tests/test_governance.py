"""Checks of a planning run, each with a case that fails; allocation folds against a loop."""

import hashlib
import json
import random
from collections import defaultdict

from demandloom.config import BacktestContract
from demandloom.operators import governance as G
from demandloom.operators import hierarchy as HI


def test_components_equal_a_search(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (900, 900), (None, 3), (5, None)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = G.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_names_tied_by_a_spelling(spark):
    wl = spark.createDataFrame([("ALPHA HYBRID", "HMA", 5.0), ("ALPHA HEV", "GMA", 2.0), ("BETA", "HMA", 1.0), ("BETA EV", "HMA", 3.0), ("GAMMA", "KUS", 4.0), ("GAMMA", "HMA", 0.0), ("", "HMA", 9.0)],
                               "model_key string, anchor_brand string, wholesale_units double")
    got = {r.component: (r.names, r.anchors, r.units, r.conflict) for r in G.mapping_conflicts(wl).collect()}
    assert got == {"ALPHA": (2, "GMA,HMA", 7.0, True), "BETA": (2, "HMA", 4.0, False), "GAMMA": (1, "KUS", 4.0, False)}


def test_each_family_fails_on_its_own_case(spark):
    make = spark.createDataFrame
    good = dict(forecast=make([("HMA",), ("KUS",)], "brand string"), sales=make([("2020-01-05", 2.0)], "sale_date string, quantity double"), wl=make([(3.0,)], "wholesale_units double"),
                facts=make([("dealer_wholesale_exact",)], "anchor_method string"), baskets=make([("2020-01", 0.0, 0.0), ("2019-01", 9.0, 9.0)], "month string, revenue_delta double, quantity_delta double"),
                reconciled=[make([(0.001, 4, "PASS")], "max_delta double, checked long, status string")], basket_from="2020-01")
    seen = lambda **kw: {r.check: r.status for r in G.validation(**{**good, **kw}).collect()}                  # noqa: E731
    names = set(seen())
    assert len(names) == 7 and set(seen().values()) == {"PASS"}
    empty = lambda k: good[k].limit(0)                                                                            # noqa: E731
    cases = {"anchor_set": (dict(forecast=make([("HMA",), ("ACME",)], "brand string")), "WARN"), "shared_cutoff": (dict(sales=make([(None, 2.0)], "sale_date string, quantity double")), "WARN"),
             "reconciliation": (dict(reconciled=[make([(5.0, 4, "FAIL")], "max_delta double, checked long, status string"), *good["reconciled"]]), "FAIL"),
             "non_negative": (dict(sales=make([("2020-01-05", -1.0)], "sale_date string, quantity double")), "FAIL"), "wholesale_denominator": (dict(wl=empty("wl")), "WARN"),
             "channel_baskets": (dict(baskets=make([("2020-02", 0.0, 0.5)], good["baskets"].schema)), "FAIL"), "model_mapping": (dict(facts=make([("hma_default_fallback",)], "anchor_method string")), "WARN")}
    assert set(cases) == names
    for name, (change, status) in cases.items():
        assert seen(**change) == {n: status if n == name else "PASS" for n in names}, name
    assert seen(baskets=empty("baskets"))["channel_baskets"] == "WARN" and seen(forecast=empty("forecast"))["anchor_set"] == "WARN"


def _month(o):
    return f"{o // 12:04d}-{o % 12 + 1:02d}"


def test_evidence_is_bound_to_its_folds(spark):
    start, months, c = 2000 * 12, 30, BacktestContract()
    keys = [(_month(start + o - 1), _month(start + o - 1 + h), h, o) for o in range(24, months) for h in c.horizons if o + h <= months]
    text = json.dumps([{"originMonth": a, "targetMonth": b, "horizon": h} for a, b, h, _ in keys], sort_keys=True, separators=(",", ":"))
    span = spark.createDataFrame([(start, months)], "start_ord int, months int")
    schema = "entity string, origin_month string, target_month string, horizon int, actual double, prediction double, training_months int"
    data = [(e, a, b, h, 1.0, 2.0, o) for a, b, h, o in keys for e in ("A", "B")]
    one = G.expected_identity(span).first()
    assert (one.fold_keys, one.identity) == (len(keys), hashlib.sha256(text.encode()).hexdigest()) == tuple(G.observed_identity(spark.createDataFrame(data, schema)).first())
    source, other = (spark.createDataFrame([(x,)], "fingerprint string") for x in "xy")
    last = _month(start + months - 1)
    registered = G.Request(cutoff=last)

    def failed(rows, request=registered, now=source):
        got = {r.check: r.passed for r in G.evidence_gate(spark.createDataFrame(rows, schema), span, now, request, registered, source, ["B", "A"]).collect()}
        assert got.pop("all") == all(got.values()) and len(got) == 17
        return {k for k, v in got.items() if not v}
    assert failed(data) == set()
    assert failed(data, G.Request("revenue", "auto", "1999-01", True, "2"), other) == {"full_scope", "source", "target", "strategy", "unfiltered", "request_cutoff", "contract_version"}
    broken = [(*r[:5], None, r[6]) if i == 4 else r for i, r in enumerate(data) if r[0] == "A" and r[1:4] != data[0][1:4]]
    assert failed(broken) == {"full_scope", "entities", "fold_counts", "fold_key_count", "fold_identity", "prediction_coverage", "full_coverage"}
    assert G.expected_identity(spark.createDataFrame([(start, 20)], "start_ord int, months int")).first().fold_keys == 0


def test_one_failing_metric_fails_the_model(spark):
    step = lambda d: spark.createDataFrame([(d, 3)], "max_delta double, checked long")                            # noqa: E731
    got = {r.check: (r.status, r.max_delta, r.checked) for r in G.rollup({"quantity": [step(0.0), step(0.01)], "revenue": [step(0.0), step(0.02)]}).collect()}
    assert got == {"quantity": ("PASS", 0.01, 6), "revenue": ("FAIL", 0.02, 6), "MODEL_STATUS": ("FAIL", 0.02, 12)}


def test_allocation_folds_equal_a_loop(spark):
    rnd, first, end = random.Random(9), 2000 * 12, 2002 * 12 + 5
    sold = {(p, c, o): float(rnd.randint(-2, 9)) for p in "PQ" for c in "abcd" for o in range(first + (0 if c < "c" else rnd.randint(3, 27)), end + 2) if rnd.random() < 0.7}
    facts = spark.createDataFrame([(p, c, _month(o), v) for (p, c, o), v in sold.items()] + [("P", "a", _month(first), None)], "p string, c string, month string, quantity double")
    s0, got = min(o for _, _, o in sold), {}
    for r in HI.allocation_folds(facts, ["p", "c"], ["p"], _month(end)).collect():
        got[r.p, r.c, r.origin_month, r.horizon] = (r.target_month, r.actual, round(r.prediction, 9), r.covered)
    sold = {k: max(v, 0.0) for k, v in sold.items() if k[2] <= end}
    sold.setdefault(("P", "a", first), 0.0)
    s0, want = min(s0, first), {}
    for p in "PQ":
        names = sorted({c for q, c, _ in sold if q == p})
        for c in names:
            for o in range(s0 + 23, end):
                known = min(m for q, d, m in sold if (q, d) == (p, c)) <= o
                sums = lambda kids, lo: sum(sold.get((p, d, m), 0.0) for d in kids for m in range(lo, o + 1))                  # noqa: B023, E731
                pr, ph = sums(names, o - 5), sums(names, s0)
                share = sums([c], o - 5) / pr if pr > 0 else sums([c], s0) / ph if ph > 0 else 0.0
                for h in (1, 2, 3):
                    if o + h <= end and (known or (p, c, o + h) in sold):
                        whole = sum(sold.get((p, d, o + h), 0.0) for d in names)
                        want[p, c, _month(o), h] = (_month(o + h), sold.get((p, c, o + h), 0.0), round(whole * share if known else 0.0, 9), known and (pr > 0 or ph > 0))
    assert got == want
