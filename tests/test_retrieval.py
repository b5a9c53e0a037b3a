import random
import re
import types

import numpy as np
import pyarrow as pa

from demandloom.operators import retrieval as X


def test_focus_alone_reaches_the_list(spark):
    q = spark.createDataFrame([(1, "working days of july", "zz9"), (2, "working days of july", ""), (3, "nothing shared", None)], "question_id long, text string, focus string")
    texts = [f"plain words number {i}" for i in range(20)] + ["about part zz9 alone", "july working days"]
    s = spark.createDataFrame([(f"s{i:02d}", "doc", f"t{i:02d}", t, [], 0.6, 6) for i, t in enumerate(texts)],
                              "snippet_id string, source string, title string, content string, tags array<string>, base_score double, priority int")
    got = {(r.question_id, r.position): (r.snippet_id, r.score) for r in X.rank_context(q, s).collect()}
    assert got[1, 1] == ("s21", 6.6) and got[1, 2] == ("s20", 3.6) and got[1, 3] == ("s00", 0.6)
    assert got[2, 1] == ("s21", 6.6) and got[2, 2] == ("s00", 0.6)
    assert len(got) == 18 and got[3, 1] == ("s00", 0.6)


def test_every_chunk_is_a_snippet(spark):
    text = "\n\n".join(f"paragraph {i} has more than forty characters of its own" for i in range(9))
    docs = spark.createDataFrame([(1, "a", text), (2, "a", None)], "doc_id long, source string, text string")
    assert X.document_snippets(docs).count() == 9 and X.document_snippets(docs, 6).count() == 6


def test_equals_all_pairs_and_few_leave_the_tasks(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["Alpha", "beta", "été", "the"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))                    # noqa: E731
    q = [(i, say(rnd.randint(0, 12)), rnd.choice(["", None, "LPH", "w1", "w39"])) for i in range(60)] + [(100, None, None), (101, "", "été")]
    s = [(f"s{i:03d}", rnd.choice("ab"), rnd.choice(["x", "y", "Alpha"]), say(rnd.randint(0, 30)), ["tag", rnd.choice(words)], rnd.choice([0.0, 0.6, 2.5, -9.0]), rnd.randint(1, 3)) for i in range(300)]
    s += [("t" + r[0], *r[1:]) for r in s[:40]] + [("long", "a", "long", say(20_000), [], 0.6, 6)]
    stop, find = set(X.T.STOP_WORDS), re.compile("[a-z0-9_]+")
    cut = lambda t: {w for w in find.findall((t or "").lower()) if len(w) > 1 and w not in stop}            # noqa: E731
    first = {}
    for r in sorted(s):
        first.setdefault(r[1:4], r)
    want = []
    for i, text, focus in q:
        rows = []
        for r in first.values():
            low = " ".join([r[2], r[3], " ".join(r[4])]).lower()
            score = round(r[5] + 2 * len(cut(text) & cut(low)) + (3 if focus and focus.lower() in low else 0), 2)
            rows += [(-score, r[6], r[2], r[0])] if score > 0 else []
        want += [(i, x[3], -x[0], k) for k, x in enumerate(sorted(rows)[:6], 1)]
    qs = spark.createDataFrame(q, "question_id long, text string, focus string")
    sn = spark.createDataFrame(s, "snippet_id string, source string, title string, content string, tags array<string>, base_score double, priority int").repartition(5)
    assert sorted(map(tuple, X.rank_context(qs, sn).collect())) == sorted(want)
    assert sorted(map(tuple, X.rank_context(qs, sn, most=50).collect())) == sorted(want)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert X.candidates(qs, sn).count() <= len(q) * 6 * tasks                       # of len(q) * 341 pairs; 4 for an answer, here
    assert X.rank_context(qs.filter("question_id < 0"), sn).count() == 0 and X.rank_context(qs, sn.filter("priority > 9")).count() == 0


def test_paragraphs_are_whole(spark):
    text = "x" * 30 + "\n\n" + "word " * 500 + "needle\n \n  " + "short"
    docs = spark.createDataFrame([(1, "a", text)], "doc_id long, source string, text string")
    got = X.document_snippets(docs).collect()
    assert len(got) == 1 and got[0].content.endswith("needle")


def test_few_pairs_are_scored_once_the_seeds_are_known():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [words[min(int(rnd.paretovariate(0.6)) - 1, 2999)] for _ in range(n)]                  # noqa: E731
    rows = [types.SimpleNamespace(question_id=i, words=sorted(set(say(20))), focus="") for i in range(200)]
    texts = sorted((" ".join(say(rnd.randint(30, 400))) for _ in range(3000)), key=len, reverse=True)
    batch = lambda t, at: pa.RecordBatch.from_pydict({"snippet_id": [f"s{at + i:04d}" for i in range(len(t))], "title": [""] * len(t), "priority": pa.array([1] * len(t), pa.int32()),
                                                      "base_score": [0.6] * len(t), "low": t})
    index = types.SimpleNamespace(value=X._Index(rows, 0.6))
    run = lambda batches, floors, seen: [(q, s, x) for b in X._streamed(index, types.SimpleNamespace(value=floors), 6, pa.int64(), scored=seen)(batches)                   # noqa: E731
                                         for q, s, x in zip(*[b.column(c).to_pylist() for c in ("question_id", "snippet_id", "score")], strict=True)]
    open_floors, every, few = np.full(200, -np.inf), [], []
    floors = X._floors(index.value, [types.SimpleNamespace(question_id=q, score=x) for q, _, x in run([batch(texts[:X.SEEDS], 0)], open_floors, [])], 6)
    tied = lambda found: sorted((q, x) for q, _, x in found)                                                   # noqa: E731
    parts = [batch(texts[i:i + 500], i) for i in range(0, 3000, 500)]
    assert tied(run(parts, open_floors, every)) == tied(run(parts, floors, few))
    assert sum(few) < sum(every) and sum(few) < 200 * 3000 / 5                   # of 600,000 pairs


def test_many_questions_meet_the_snippets_in_cells(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["alpha", "été", "the"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))                    # noqa: E731
    q = [(i, say(rnd.randint(0, 15)), rnd.choice(["", None, "lph", "w1", "W5 w", *[f"w{j}" for j in range(20)]])) for i in range(80)]
    q += [(100, None, None), (101, "", "été"), (102, "nothing", "zz"), (7, say(9), ""), (7, say(9), "w1"), (None, say(5), ""), q[3]]
    s = [(f"s{i:03d}", "a", rnd.choice(["x", "y", None]), say(rnd.randint(0, 40)), ["tag", rnd.choice(words)], rnd.choice([0.0, 0.6, 2.5, -9.0]), rnd.choice([1, 2, None])) for i in range(250)]
    s += [("t" + r[0], *r[1:]) for r in s[:30]] + [("long", "a", "long", say(9000), [], 0.6, 6)]
    schema = "question_id long, text string, focus string", "snippet_id string, source string, title string, content string, tags array<string>, base_score double, priority int"
    qs, sn = spark.createDataFrame(q, schema[0]), spark.createDataFrame(s, schema[1]).repartition(3)
    of = lambda **kw: sorted(map(repr, X.rank_context(qs, sn, **kw).collect()))      # noqa: E731
    stop, find = set(X.T.STOP_WORDS), re.compile("[a-z0-9_]+")
    cut = lambda t: {w for w in find.findall((t or "").lower()) if len(w) > 1 and w not in stop}            # noqa: E731
    first, pairs = {}, {}
    for r in sorted(s, key=lambda r: r[0]):
        first.setdefault(r[1:4], r)
    for i, text, focus in q:
        for r in first.values():
            low = " ".join([x for x in (r[2], r[3], " ".join(r[4])) if x is not None]).lower()
            score = round(r[5] + 2 * len(cut(text) & cut(low)) + (3 if focus and focus.lower() in low else 0), 2)
            if score > 0:
                pairs.setdefault(i, []).append((-score, r[6] or 0, r[2] or "", r[0]))
    want = sorted(repr((i, x[3], -x[0], k)) for i, rows in pairs.items() for k, x in enumerate(sorted(rows)[:6], 1))
    plain = lambda **kw: sorted(repr((r.question_id, r.snippet_id, r.score, r.position)) for r in X.rank_context(qs, sn, **kw).collect())            # noqa: E731
    monkeypatch.setattr(X, "_Index", None)                                              # no index of all questions
    monkeypatch.setattr(X, "LONGEST", 5)
    for cell in (200, 3000, 10**7):
        assert plain(most=0, cell=cell) == want
    monkeypatch.setattr(X, "MOST_TERMS", 2)
    assert of(most=0, cell=2000) == of(most=0)
    assert X.rank_context(qs, sn.filter("priority > 9"), most=0).count() == 0


def test_a_floor_leaves_common_words_unread():
    n, rnd = 4000, random.Random(1)
    rows = [["common", "often" if rnd.random() < 0.5 else "never", f"rare{i % 400}"] for i in range(n)]
    keys = pa.array([w for r in rows for w in r]).dictionary_encode()
    index = X._Postings([(np.arange(n), np.full(n, 0.6), np.full(n, 3), keys)], 0)
    met, seen = index.met, []
    index.met = lambda starts, ends, term: (seen.append(sum(ends) - sum(starts)), met(starts, ends, term))[1]
    code = [index.keys.index(w).as_py() for w in ("rare7", "often", "common")]
    at, score = index.best(index.start[code].tolist(), [int(index.start[c + 1]) for c in code], None, -1, 6.6, 6)
    assert sorted(index.id[at].tolist()) == [i for i, r in enumerate(rows) if r[1:] == ["often", "rare7"]][:6] and set(score) == {6.6}
    assert seen == [10]                                                                # of 6,000 places
