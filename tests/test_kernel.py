"""The batch form of method selection against its definition as a Column expression."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.functions import forecast as FC
from demandloom.functions import kernel as K


def histories():
    rnd = np.random.default_rng(3)
    out = [[], [1.0], [2.0, 3.0], [1.0, 2.0, 3.0], [0.0] * 4, [0.0] * 30, [5.0] * 40, [0.0, 0.0, 0.0, 0.0, 9.0]]
    for i in range(300):
        n = int(rnd.integers(4, 60))
        base = rnd.choice([0.0, 20.0, 500.0]) + rnd.normal(0, 10, n) + np.arange(n) * rnd.choice([0.0, 1.0, -0.5])
        season = rnd.choice([0.0, 30.0]) * np.sin(np.arange(n) * np.pi / 6)
        h = np.maximum(0.0, base + season)
        h[rnd.random(n) < rnd.choice([0.0, 0.3, 0.7])] = 0.0
        h[rnd.random(n) < 0.05] *= 12
        out.append(np.round(h, rnd.choice([0, 3])).tolist())
    return out


@pytest.mark.parametrize("seasonal", [True, False])
def test_batches_choose_what_the_columns_choose(spark, seasonal):
    rows = [(i, h) for i, h in enumerate(histories())] + [(9999, None)]
    df = spark.createDataFrame(rows, "id int, h array<double>").repartition(3)
    want = {r.id: r for r in FC.once(df, "b", FC.select_best(F.col("h"), seasonal), FC.BEST).collect()}
    got = {r.id: r for r in FC.with_best(df, use_seasonality=seasonal).collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    seen = set()
    for i, w in want.items():
        g = got[i]
        assert (g.b_model, g.b_preprocessing, g.b_adjusted) == (w.b_model, w.b_preprocessing, w.b_adjusted), (i, g, w)
        for f in ("b_mae", "b_wape", "b_bias"):
            a, b = g[f], w[f]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-11, abs=1e-11)), (i, f, a, b)
        assert (g.b_train is None) == (w.b_train is None) and (g.b_train is None or g.b_train == pytest.approx(w.b_train, rel=1e-12))
        seen.add(w.b_model)
    assert len(seen) >= (11 if seasonal else 8)


def test_every_method_alone(spark):
    hs = [h for h in histories() if len(h) >= 4]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "id int, h array<double>")
    names = [m for m, _, _ in FC.BASELINE_MODELS]
    want = {r.id: r for r in df.select("id", *[F.get(FC.path(F.col("h"), m, 1), 0).alias(m) for m in names]).collect()}
    for i, h in enumerate(hs):
        got = K.one_step(np.array([h + [0.0]]), np.array([0]), np.array([len(h)]))
        for m in names:
            assert got[m][0] == pytest.approx(want[i][m], rel=1e-11, abs=1e-11), (i, m)


def test_anomalies(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(histories())] + [(9999, None)], "id int, h array<double>").repartition(3)
    want = {r.id: r.a for r in df.select("id", FC.anomalies(F.col("h"), 4).alias("a")).collect()}
    got = {r.id: r.a for r in df.select("id", K.anomalies_of(F.col("h"), 4).alias("a")).collect()}
    assert sum(map(bool, want.values())) > 100
    for i, w in want.items():
        assert [(a.position, a.severity) for a in w or []] == [(a.position, a.severity) for a in got[i] or []], i
        for a, b in zip(w or [], got[i] or [], strict=True):
            for f in ("neg", "actual", "baseline", "delta_pct", "score"):
                assert b[f] == pytest.approx(a[f], rel=1e-11) if a[f] is not None else b[f] is None


def test_batches_are_worked_off_in_parts(monkeypatch):
    hs = (histories() * 8)[:2 * K.AT_ONCE + 7]
    own, held = K.softened, []
    monkeypatch.setattr(K, "softened", lambda v, n: held.append(len(v)) or own(v, n))
    got, odd = K.best(hs), K.anomalies(hs, 4)
    assert max(held) <= K.AT_ONCE < sum(held)
    monkeypatch.setattr(K, "AT_ONCE", len(hs))
    whole = K.best(hs)
    assert len(got) == len(hs) and odd == K.anomalies(hs, 4)
    for a, b in zip(got, whole, strict=True):
        assert (a is None) == (b is None) and (a is None or (a[:2] == b[:2] and a[5] == b[5] and a[2] == pytest.approx(b[2], rel=1e-12) and list(a[6]) == pytest.approx(list(b[6]))))
