"""Near-duplicate groups by SimHash, with pigeonring filtering of candidate pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table
from .registry import query

BITS = 64
#: A bucket of equal segments with more distinct fingerprints than this is linked through midpoints, not pairs.
PAIR_BUCKET = 32


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum() - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    return np.array([digest(line[a:b], 42) for a, b in spans], np.uint64)


def fingerprint_of(text: str | None, size: int = 3) -> int:
    """64-bit SimHash as a signed integer; a bit is set if it is set in over half the shingle hashes."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """SimHash of a text column over word shingles, as a long."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size) for t in texts], dtype="int64")
    return of(text)


def _segments(n: int) -> list[tuple[int, int]]:
    """n segments of the 64 bits: (shift, width)."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _chain(x: Column, y: Column, first: int, segments: list[tuple[int, int]], distance: int) -> Column:
    """Pigeonring test: going round the segments from ``first``, the differences of every leading chain of length l
    stay within l * distance / n. Any pair within ``distance`` passes from at least one start."""
    diff, seen, ok = x.bitwiseXOR(y), None, F.lit(True)
    for step in range(len(segments)):
        shift, width = segments[(first + step) % len(segments)]
        part = F.bit_count(diff.bitwiseAND(F.lit(_signed(((1 << width) - 1) << shift))))
        seen = part if seen is None else seen + part
        ok = ok & (seen <= (step + 1) * distance // len(segments))
    return ok & (F.bit_count(diff) <= distance)


def _signed(v: int) -> int:
    return v - (1 << BITS) if v >= 1 << (BITS - 1) else v


def links(nodes: DataFrame, distance: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) between rows of nodes(id, fp) whose fingerprints differ in at most ``distance`` (0 to 2) bits.

    ``fp`` is distinct. The result spans every group: two ids within the distance are linked directly or through
    others, and every link joins ids within the distance.

    The ring has distance + 1 segments, so a chain can only start at a segment without differences: ids meet in
    buckets of equal segments and pairs of a bucket are tested along the ring. A bucket of more than ``pair_bucket``
    ids emits no pairs: each of its fingerprints names itself and its 64 neighbours one bit away; two fingerprints
    within two bits name a common midpoint, and whoever shares a midpoint (65 at most) is within two bits. That is
    exact, and grows with the number of ids.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance must be 0, 1 or 2")
    if distance == 0:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    segments = _segments(distance + 1)
    keys = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("v")) for i, (s, w) in enumerate(segments)]
    rows = cut(nodes.select("id", "fp", F.explode(F.array(*keys)).alias("k")).select("id", "fp", "k.i", "k.v"))
    size = rows.groupBy("i", "v").count().where("count > 1")
    few, many = size.where(F.col("count") <= pair_bucket).select("i", "v"), size.where(F.col("count") > pair_bucket).select("i", "v")

    one = lambda i: (lambda x: F.transform(F.filter("g", lambda y: (y["fp"] > x["fp"]) & _chain(x["fp"], y["fp"], i, segments, distance)),
                                           lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"))))
    tests = [F.when(F.col("i") == i, F.flatten(F.transform("g", one(i)))) for i in range(len(segments))]
    pairs = (rows.join(few, ["i", "v"], "left_semi").groupBy("i", "v").agg(F.collect_list(F.struct("id", "fp")).alias("g"))
             .select(F.explode(F.coalesce(*tests)).alias("p")).select("p.a", "p.b"))

    hot = rows.join(many, ["i", "v"], "left_semi").select("id", "fp").distinct()
    flips = F.array(*[F.lit(_signed(1 << b)) for b in range(BITS)])
    if distance == 2:
        middle = F.concat(F.array("fp"), F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m)))
        spread = hot.select("id", F.explode(middle).alias("m"))
    else:                                        # one bit apart: equal once that bit is cleared
        spread = hot.select("id", F.explode(F.transform(flips, lambda m: F.struct(m.alias("bit"), F.col("fp").bitwiseAND(F.bitwise_not(m)).alias("rest")))).alias("m"))
    shared = spread.groupBy("m").agg(F.collect_set("id").alias("g")).where(F.size("g") > 1)
    stars = shared.select(F.array_min("g").alias("a"), F.explode("g").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def groups(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """One row (doc_id, fp, component_id) per row of ``docs``: its SimHash and the smallest doc_id reachable over links.

    Equal fingerprints are one node, so a group of copies is one row before links are sought. A null text counts as
    empty; texts without words have fingerprint 0 and are linked like others. Rows that repeat a doc_id are kept; a
    null doc_id comes after all others and only names a component that has no other id (component_id is then null).
    """
    prints, label = _labelled(docs, size, distance)
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


LAST = (1 << 63) - 1


def _labelled(docs: DataFrame, size: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """prints(doc_id, text_hash, fp) of every row, and label(fp, component, component_id) of every fingerprint."""
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text"), size).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).alias("rep")))
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp"), distance))
    named = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = named.join(least, "component").select("fp", "component", F.when(F.col("component_id") != LAST, F.col("component_id")).alias("component_id"))
    return prints, label


def drop_near_copies(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """Keep one row of every group, that of the smallest doc_id (a null one comes last); all columns of ``docs`` stay.

    Of rows that repeat that doc_id, the one with the smallest hash of its text stays, and of whole repeats any one.
    """
    return first_rows(docs, *_labelled(docs, size, distance))


def first_rows(docs: DataFrame, prints: DataFrame, label: DataFrame) -> DataFrame:
    """The row of ``docs`` that each component of label(fp, component) keeps; prints has doc_id, text_hash, fp."""
    first = prints.join(label, "fp").groupBy("component").agg(F.min(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "text_hash")).alias("k"))
    keep = first.select(F.struct(F.nullif(F.col("k.col1"), F.lit(LAST)).alias("d"), F.col("k.text_hash").alias("t")).alias("__keep"))
    own = F.struct(docs["doc_id"].cast("long").alias("d"), F.xxhash64(docs["text"]).alias("t"))
    kept = docs.join(keep, own.eqNullSafe(F.col("__keep")), "left_semi")
    repeats = prints.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, path: str) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups(table(spark, path, "documents")).select("doc_id", hexed.alias("fingerprint"), "component_id")
