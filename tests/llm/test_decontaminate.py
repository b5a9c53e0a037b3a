import hashlib
import re

import numpy as np
import pytest

from demandloom.llm.decontaminate import judged, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def slow(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b:b + n] == v[a:a + n]:
                    hit |= set(range(b, b + n))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most_sent", [1_000_000, 0])
def test_against_brute_force(spark, rows, most_sent):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(rng.choice(["aa", "bb", "cc", "é1"], n))
    items = [(1, say(30)), (2, say(13)), (3, "Short One"), (4, ""), (5, None), (6, say(40)), (10, None)]
    items += [(7, items[0][1])]
    texts = [say(20) + " " + items[0][1] + "! " + say(9), items[5][1][20:80].upper(), "a short, ONE b", say(300), None, "", "x " * 3000 + items[1][1], items[1][1]]
    docs = rows(*enumerate(texts), (7, texts[7]), more=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = judged(docs, bench, most_sent=most_sent).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == slow(texts[r.doc_id], items), r
    kept = without_contaminated(docs, bench)
    bad = {r.doc_id for r in got if r.contaminated}
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if i not in bad] and kept.columns == docs.columns


def test_empty_tables(spark, rows):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert judged(rows().limit(0), bench).count() == 0
    assert [r.n_hit for r in judged(rows((1, "a b")), bench.limit(0)).collect()] == [0]


def test_an_item_on_several_rows_is_one_item(spark, rows):
    twice = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(7, twice), (7, twice), (7, "other words"), (None, twice), (8, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.items_sha256, r.n_hit) for r in judged(rows((1, "so " + twice), (2, "other words here")), bench).collect()}
    digest = lambda ids: hashlib.sha256(ids.encode()).hexdigest()                                                # noqa: E731
    assert got == {1: (2, digest(",7"), 15), 2: (1, digest("7"), 2)}
