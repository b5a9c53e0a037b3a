"""Near copies by the Jaccard likeness of word shingles: MinHash bands propose pairs, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from . import simhash
from .simhash import PAIR_BUCKET, first_rows, shingle_hashes

#: Words of a shingle, and the share of common shingles from which two texts are near copies.
SHINGLE, LIKENESS = 5, 0.8
#: Bands of so many MinHash values each. A pair of likeness 0.8 shares no band with a chance of 3 in a million.
BANDS, ROWS = 32, 5
_RNG = np.random.default_rng(17)
_MUL, _ADD = (_RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; two sets share it if (but for hash collisions) all its MinHash values are equal."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = hashes[at:at + 1024] * _MUL + _ADD
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(1))
    return [xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def _prints(text: Column, size: int) -> Column:
    @F.pandas_udf("fp long, n int, bands array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingle_set(t, size) for t in batch]
            yield pd.DataFrame({"fp": [xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63) for s in sets], "n": [len(s) for s in sets], "bands": [bands(s) if len(s) else [] for s in sets]})
    return of(text)


def _sets(text: Column, size: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(t, size).view(np.int64) for t in batch])
    return of(text)


def _alike(pairs: DataFrame, docs: DataFrame, prints: DataFrame, size: int, likeness: float) -> DataFrame:
    """Those of pairs(a, b) whose whole shingle sets are alike. Only texts that stand in a pair are read again."""
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    one = prints.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text_hash").alias("text_hash"))
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(one, "text_hash").groupBy("fp").agg(F.any_value("text").alias("text"))
    sets = cut(texts.select("fp", _sets(F.col("text"), size).alias("s")))
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    return cut(common.where(F.col("common") / (F.col("n") - F.col("common")) >= likeness).select("a", "b"))


def links(docs: DataFrame, prints: DataFrame, size: int, likeness: float, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) between the distinct shingle sets of prints(fp, n, bands, text_hash) that span every group of near copies.

    Sets meet in buckets of equal bands. A bucket of up to ``pair_bucket`` sets gives all its pairs. A larger one first
    gives the pairs of one of its sets with all others (another one in each of its members' bands); then only members
    that are still outside the bucket's main component meet those of other components. Pairs inside one component
    need no test, so what is left out changes no group.
    """
    nodes = prints.where("n > 0").groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    rows = cut(nodes.select("fp", "n", F.explode("bands").alias("band")))
    held = rows.groupBy("band").agg(F.count(F.lit(1)).alias("held"), F.min_by(F.struct("fp", "n"), F.xxhash64("band", "fp")).alias("pivot")).where("held > 1")
    held = cut(held)
    fits = lambda n, m: F.least(n, m) >= F.lit(likeness) * F.greatest(n, m)
    small = rows.join(held.where(F.col("held") <= pair_bucket).select("band"), "band", "left_semi").groupBy("band").agg(F.collect_list(F.struct("fp", "n")).alias("g"))
    of = lambda x: F.transform(F.filter("g", lambda y: (y["fp"] > x["fp"]) & fits(x["n"], y["n"])), lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b")))
    pairs = small.select(F.explode(F.flatten(F.transform("g", of))).alias("p")).select("p.a", "p.b")
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    hot = cut(rows.join(held.where(F.col("held") > pair_bucket).select("band", "pivot"), "band"))
    stars = hot.where((F.col("fp") != F.col("pivot.fp")) & fits(F.col("n"), F.col("pivot.n"))).select(*ordered(F.col("fp"), F.col("pivot.fp")))
    found = _alike(pairs.union(stars).distinct(), docs, prints, size, likeness)
    if hot.limit(1).count() == 0:
        return found
    named = hot.drop("pivot").join(components(found).withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named)
    main = named.groupBy("band", "component").count().groupBy("band").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    apart = cut(named.join(main, "band").where("component <> main").select("band", F.col("fp").alias("o"), F.col("n").alias("m"), F.col("component").alias("c")))
    met = apart.join(named, "band").where((F.col("component") != F.col("c")) & fits(F.col("n"), F.col("m"))).select(*ordered(F.col("fp"), F.col("o"))).distinct()
    return found.union(_alike(met, docs, prints, size, likeness))


def _joined(prints: DataFrame, distance: int, pair_bucket: int) -> DataFrame:
    """Links (a, b) that join the shingle sets of prints(fp, sim) whose SimHashes are connected within ``distance`` bits."""
    sims = cut(prints.select(F.col("sim").alias("id"), F.col("sim").alias("fp")).distinct())
    found = simhash.components(simhash.links(sims, distance, pair_bucket)).withColumnRenamed("id", "sim")
    group = F.coalesce("component", "sim").alias("group")
    held = cut(prints.select("sim", "fp").distinct().join(found, "sim", "left").select("fp", group).distinct())
    return held.join(held.groupBy("group").agg(F.min("fp").alias("a")), "group").where("a <> fp").select("a", F.col("fp").alias("b"))


def drop_copies(docs: DataFrame, distance: int = 2, size: int = SHINGLE, likeness: float = LIKENESS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Keep one row of every group of near copies, as ``drop_similar`` does, where links are those of both methods.

    Two texts are near copies if their SimHashes (op10: three-word shingles, pigeonring chains) differ in at most
    ``distance`` bits, or if ``drop_similar`` calls them so; groups are what links of either kind connect.
    """
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), simhash.fingerprint(F.col("text")).alias("sim"), _prints(F.col("text"), size).alias("p"))
                 .select("doc_id", "text_hash", "sim", "p.*"))
    every = links(docs, prints, size, likeness, pair_bucket).union(_joined(prints, distance, pair_bucket))
    return _first(docs, prints, components(every))


def drop_similar(docs: DataFrame, size: int = SHINGLE, likeness: float = LIKENESS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Keep one row of every group of near copies, that of the smallest doc_id (a null one comes last); all columns stay.

    Two texts are near copies if at least ``likeness`` of all their distinct runs of ``size`` words (ASCII case and
    white space apart; a shorter text is one run) stand in both; groups are what such pairs connect. A pair counts
    only on its whole sets. Texts without words form one group. Of rows that repeat the doc_id, the one with the
    smallest hash of its text stays, and of whole repeats any one.
    """
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _prints(F.col("text"), size).alias("p")).select("doc_id", "text_hash", "p.*"))
    return _first(docs, prints, components(links(docs, prints, size, likeness, pair_bucket)))


def _first(docs: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` that each group of found(id, component) over the sets of prints keeps."""
    label = prints.select("fp").distinct().join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    return first_rows(docs, prints, label)
