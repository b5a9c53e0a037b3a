import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from demandloom.llm.common import components, ranked
from demandloom.llm.simhash import drop_near_copies, fingerprint_of, groups, links


def slow_print(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    grams = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint_by_hand(spark):
    for t in ["", None, "One", "a B c d", "é ü ñ x y z z z z", "w " * 5000]:
        assert fingerprint_of(t) % (1 << 64) == slow_print(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("bucket", [1, 32])
def test_links_span_the_same_groups_as_all_pairs(spark, distance, bucket):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 12).tolist()
    fps = {s ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(12)}
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= distance:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    nodes = spark.createDataFrame([(f, f) for f in fps], "id long, fp long")
    found = links(nodes, distance, bucket)
    assert all(bin(r.a ^ r.b).count("1") <= distance for r in found.collect())
    label = {r.id: r.component for r in components(found).collect()}
    assert {f: label.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_groups_and_kept_rows(rows):
    long = " ".join(f"w{i}" for i in range(400))
    docs = rows((5, long), (3, long), (9, long.upper()), (4, None), (6, "  "), (8, "other words here"), (8, "other words here"), more=True)
    got = {(r.doc_id, r.component_id) for r in groups(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (4, 4), (6, 4), (8, 8)}
    kept = drop_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 8] and kept.columns == docs.columns
    assert drop_near_copies(rows().limit(0)).count() == 0


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    assert all(r.v == r["rank"] for r in ranked(df, F.col("v")).collect())
