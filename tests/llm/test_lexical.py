import math
import random
import re
from collections import Counter

from demandloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def spelled(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slowly(docs, items, top=10):
    held = [(d, Counter(spelled(t))) for d, t in docs if spelled(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(spelled(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, k, f[2], -f[0]) for k, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def test_equals_brute_force_in_one_or_many_indexes(spark, rows):
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gämma", "été", "x1", "日本", "the", "THE", "ÀB"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "-", "\n", ". ", "_"]) for _ in range(n))         # noqa: E731
    docs = [(i, text(rnd.randint(1, 40))) for i in range(120)] + [(200, None), (201, ""), (202, "..."), (203, text(9000)), (None, "alpha beta x1")]
    docs += [(300 + i, docs[5][1]) for i in range(30)] + [docs[6]]                                                   # ties and a repeated row
    items = [(f"q{i}", text(rnd.randint(1, 12))) for i in range(25)] + [("empty", ""), ("none", None), (None, "alpha w1"), ("q1", "w2 w3"), ("strange", "notthere")]
    df = rows(*docs, more=True).withColumnRenamed("keys", "item_id").repartition(5)
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id string, text string, doc_id int, score int")
    want = slowly(docs, items)
    assert sorted(map(tuple, lexical.rank(df, asked).collect()), key=str) == want
    assert sorted(map(tuple, lexical.rank(df, asked, most_postings=20).collect()), key=str) == want
    assert sorted(map(tuple, lexical.rank(df, asked, top=3).collect()), key=str) == slowly(docs, items, 3)


def test_empty_tables(spark, rows):
    none, some = rows((1, "a b")).where("doc_id < 0"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert lexical.rank(none, some).count() == 0
    assert lexical.rank(rows((1, "a b")), some.where("item_id = ''")).count() == 0
    assert [tuple(r) for r in lexical.rank(rows((1, "a b")), some).select("item_id", "rank", "doc_id").collect()] == [("q", 1, 1)]
