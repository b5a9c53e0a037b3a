import math
import random

import numpy as np
from pyspark.sql import functions as F

from demandloom.llm import negatives


def slowly(rows, anchor, n_pos, n_neg, low, high):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
             if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    whole = {i: (lab, v) for i, lab, v in sorted(whole, reverse=True)}
    out = []
    for a, (lab, v) in whole.items():
        if not anchor(a):
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, m) for b, (m, w) in whole.items() if b != a)
        for s, p, _ in [o for o in others if o[2] == lab][:n_pos]:
            inside = [o for o in others if o[2] != lab and low * -s <= 100 * -o[0] <= high * -s][:n_neg]
            out += [(a, p, k, o[1], -s, -o[0]) for k, o in enumerate(inside, 1)]
    return sorted(out)


def check(spark, monkeypatch, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("anchor_id", F.lit(1)).withColumn("score", F.lit("x"))
    got = negatives.mine(negatives.vectors(df.repartition(3)), F.col("vec_id") % 5 == 0, **options)
    o = {"n_positives": 5, "n_negatives": 10, "low": 30, "high": 90} | options
    want = slowly(rows, lambda i: i % 5 == 0, o["n_positives"], o["n_negatives"], o["low"], o["high"])
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 7)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], rnd.randint(0, 2)) for i in range(90)]      # many ties
    rows += [(200 + i, [1.0, 1.0, 1.0, 1.0], 0) for i in range(20)]                                                      # copies
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 1.0], 1), (302, [float("nan")] * 4, 1), (303, [float("inf")] * 4, 1), (304, [1.0] * 4, None),
             (None, [1.0] * 4, 1), (305, [1.0, 0.5], 1), (310, [], 2), (320, [0.0] * 4, 7), rows[3]]
    assert len(check(spark, monkeypatch, rows)) > 300
    check(spark, monkeypatch, rows, n_positives=2, n_negatives=3, low=0, high=100)


def test_large_components_and_empty(spark, monkeypatch):
    rows = [(i, [float(i * 100_000 + 1), 1.0], i % 2) for i in range(12)]
    check(spark, monkeypatch, rows)
    assert check(spark, monkeypatch, []) == []


def test_zero_scores_stand_behind_their_positive(spark, monkeypatch):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (9, [0.0, 1.0], 0), (3, [0.0, 0.5], 1)]
    assert [r[:4] for r in check(spark, monkeypatch, rows)] == [(0, 9, 1, 1), (0, 9, 2, 3)]


def test_anchors_are_not_sent_to_every_task(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 3) for i in range(200)], "vec_id long, embedding array<double>, label int")
    found = negatives.mine(negatives.vectors(rows), F.col("vec_id") % 5 == 0)
    assert "Broadcast" not in found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().sparkPlan().toString() and found.count()


def test_firsts_of_windows_as_rows_pass(monkeypatch):
    monkeypatch.setattr(negatives, "SCORED", 3)
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (400, 2))
    v[250:300] = v[5]                                               # many equal scores
    labels, ids, most = rng.integers(0, 3, 400), rng.permutation(400), 4
    packed = [x.astype("<i8").tobytes() for x in v]
    own = np.arange(0, 400, 40)
    s = v[own] @ v.T
    for same, low, high in ((True, [[-99]], [[99]]), (False, [[2, -5, 1]], [[9, 0, 0]])):
        low, high = np.repeat(low, len(own), 0), np.repeat(high, len(own), 0)
        f = negatives.Firsts(ids[own], labels[own], [packed[i] for i in own], low, high, same, most)
        for k in range(0, 400, 150):
            f.meet(ids[k:k + 150], labels[k:k + 150], packed[k:k + 150])
        want = set()
        for i, a in enumerate(own):
            for w in range(low.shape[1]):
                fit = [j for j in range(400) if (labels[j] == labels[a]) == same and ids[j] != ids[a] and low[i, w] <= s[i, j] <= high[i, w]]
                want |= {(ids[a], s[i, j], ids[j]) for j in sorted(fit, key=lambda j: (-s[i, j], ids[j]))[:most]}
        got = f.pairs().to_pydict()
        assert sorted(zip(got["anchor_id"], got["score"], got["other"], strict=True)) == sorted(want) and set(got["kind"]) == {0 if same else 1}
