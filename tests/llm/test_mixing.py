import numpy as np

from demandloom.llm.mixing import mix, mixed, whole_copies
import pandas as pd


def filled(sizes, weights, most=3):
    """Targets by hand: raise a common level until the words are spent."""
    total, capped = sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(most * sizes[i] for i in capped)) / sum(weights[i] for i in rest)
        new = {i for i in rest if weights[i] * level > most * sizes[i]}
        if not new:
            return [most * s if i in capped else weights[i] * level for i, s in enumerate(sizes)]
        capped |= new


def test_mix_meets_targets_and_caps(rows):
    rng = np.random.default_rng(1)
    given = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "abcde"[min(i % 9, 4)]) for i in range(300)] + [(1000, None, None), (1001, "x y", None), (7, "x y z", "b"), (7, "x y z", "b"), (8, "", "a")]
    out = mix(rows(*given, more=True)).toPandas()
    assert len(out) == len(given) and (out["taken"] <= 3 * out["size"]).all() and (out["taken"] == out["copies"] * out["size"]).all()
    s = out.groupby("source", dropna=False, sort=True).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    want = filled(s["size"].tolist(), [5, 2, 1, 5, 2, 1][:len(s)])
    assert np.allclose(s["target"], want, rtol=1e-9)
    assert (abs(s["taken"] - s["target"]) <= 2).all()
    again = mix(rows(*given)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out[key].sort_values(key).to_numpy().tolist() == again[key].sort_values(key).to_numpy().tolist()


def test_mixed_rows_and_empty(rows):
    docs = rows((1, "a b c", "x"), (2, "a", "y"), (3, None, "y"), more=True)
    taken = mix(docs).toPandas()
    out = mixed(docs).toPandas()
    assert len(out) == taken.loc[taken["size"] > 0, "copies"].sum() and set(docs.columns) <= set(out.columns)
    assert mix(rows().limit(0)).count() == 0


def test_whole_copies_pass_on_what_is_owed():
    out = whole_copies(pd.DataFrame({"source": ["a"] * 3, "size": [100, 10, 1], "n": [1, 5, 9], "rate": [0.4, 1.0, 1.0]}), 3)
    assert abs((out["copies"] * out["size"]).sum() - (40 + 50 + 9)) <= 1
