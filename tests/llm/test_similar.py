import numpy as np
import pytest

import corpus_pipeline
from demandloom.llm.similar import bands, drop_similar, shingle_set

VOCABULARY = [f"{a}{b}{c}" for a in "bdfg" for b in "aei" for c in "lmnr"]


def edited(words, rng, places):
    """``words`` with other words at so many places, spread evenly."""
    out = list(words)
    for at in np.linspace(3, len(words) - 4, places).astype(int):
        out[at] = f"new{rng.integers(1 << 30)}"
    return out


def kept_slowly(texts):
    grams = lambda t: {tuple(w[i:i + 5]) for w in [t.lower().split()] for i in range(max(len(w) - 4, 1))} if t.split() else set()
    sets, label, changed = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}, True
    alike = [(a, b) for a in texts for b in texts if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)]
    while changed:
        changed = False
        for a, b in alike:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(i for i in texts if label[i] == i)


@pytest.fixture
def texts():
    rng = np.random.default_rng(5)
    out = {}
    for k, places in enumerate((1, 2, 3, 5, 7, 8, 12, 20)):      # likenesses from 0.98 down to 0.5
        words = rng.choice(VOCABULARY, 400).tolist()
        out[10 * k], out[10 * k + 1] = " ".join(words), " ".join(edited(words, rng, places))
        out[10 * k + 2] = " ".join(rng.choice(VOCABULARY, 400))
    words = rng.choice(VOCABULARY, 200).tolist()
    for k in range(60):                                          # a large group, some of it connected only through others
        out[200 + k] = " ".join(edited(words, rng, k % 5))
    out |= {300: "", 301: " \n", 302: "a b", 303: "A  b", 304: "a b c"}
    return out


@pytest.mark.parametrize("bucket", [1, 4, 32])
def test_near_copies_of_a_few_edited_words(rows, texts, bucket):
    docs = rows(*texts.items(), more=True)
    kept = drop_similar(docs, pair_bucket=bucket)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == kept_slowly(texts)


def test_stage_groups_copies_of_likeness_eight_tenths_and_more(spark, rows, texts):
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, rows(*texts.items()), "").collect()) == kept_slowly(texts)
    assert {1, 11, 21, 31, 41}.isdisjoint(kept_slowly(texts)) and {61, 71} <= set(kept_slowly(texts))


def test_rows_that_repeat_and_null_ids(rows):
    long = " ".join(f"w{i}" for i in range(100))
    got = drop_similar(rows((5, long), (3, long + " end"), (None, long), (8, "other words"), (8, "other words"), (4, None), (6, " "))).collect()
    assert sorted(r.doc_id for r in got) == [3, 4, 8]


def test_bands_meet_at_eight_tenths():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, (2000, 110), np.uint64)
    met = [len(set(bands(x[:99])) & set(bands(x[11:]))) for x in pool]      # 88 of 110 in common
    assert min(met) > 0 and abs(np.mean(met) / 32 - 0.8 ** 5) < 0.02
    assert not len(shingle_set(None))
