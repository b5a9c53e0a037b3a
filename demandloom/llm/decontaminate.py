"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import cut, table, within
from .registry import query

#: Words of a window, and of the k-grams that are hashed inside it.
WINDOW, GRAM = 13, 5
#: Up to so many benchmark fingerprints go to every task as one sorted array (8 bytes each); beyond, all
#: document fingerprints meet them in a join.
MOST_SENT = 1_000_000

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and characters beyond ASCII, after A-Z is lower-cased."""
    return (text or "").encode().translate(_KEEP).split()


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k word hashes."""
    out = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest hash (the last of equal ones) in every run of ``span`` k-grams."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, span)[:, ::-1]
    return np.unique(np.arange(len(runs)) + span - 1 - runs.argmin(1))


def fingerprints(tokens: list[bytes], length: int, gram: int, wanted: np.ndarray | None) -> list[tuple[int, int, int, bytes]]:
    """(hash, place, lead, context) of the winnowed k-grams of windows of ``length`` words; those in ``wanted`` only.

    The context holds every word of every window that has the k-gram; ``lead`` of its words stand before the k-gram.
    """
    k = min(gram, length)
    if len(tokens) < length:
        return []
    grams = gram_hashes(np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens)), k)
    at = winnow(grams, length - k + 1)
    if wanted is not None:
        if not len(wanted):
            return []
        near = np.minimum(np.searchsorted(wanted, grams[at]), len(wanted) - 1)
        at = at[wanted[near] == grams[at]]
    rest = length - k
    return [(h, p, p - max(p - rest, 0), b" ".join(tokens[max(p - rest, 0):p + k + rest])) for h, p in zip(grams[at].view(np.int64).tolist(), at.tolist(), strict=True)]


_PRINT = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("place", T.IntegerType()),
                       T.StructField("lead", T.IntegerType()), T.StructField("context", T.StringType())])


def _scan(frame: DataFrame, lengths: list[int], gram: int, wanted=None, own: int | None = None) -> DataFrame:
    """For each row (key..., text): one row with n_words, and one for each fingerprint.

    lengths: window lengths to fingerprint. own: fingerprint each text once, by windows of min(own, its words).
    wanted: a broadcast of sorted hashes for each length.
    """
    keys = [f for f in frame.schema.fields if f.name != "text"]
    schema = T.StructType([*keys, T.StructField("n_words", T.LongType()), *_PRINT.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, counts = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens = words(text)
                rows.append(i)
                counts.append(len(tokens))
                found.append((None,) * 5)
                for length in lengths if own is None else [min(own, len(tokens))] if tokens else []:
                    for p in fingerprints(tokens, length, gram, None if wanted is None else wanted.value[length]):
                        rows.append(i)
                        counts.append(None)
                        found.append((length, *p[:3], p[3].decode()))
            take = pa.array(rows, pa.int64())
            cols = [batch.column(f.name).take(take) for f in keys] + [pa.array(counts, pa.int64())]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            cols += [pa.array([f[j] for f in found], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
    return frame.mapInArrow(scan, schema)


@F.pandas_udf(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
def extended(length: pd.Series, gram: pd.Series, place: pd.Series, lead: pd.Series, context: pd.Series, item_lead: pd.Series, item_context: pd.Series) -> pd.DataFrame:
    """The words of the document around a common k-gram that agree with the item's: [lo, hi), null below ``length``."""
    out = []
    for n, k, p, a, mine, b, theirs in zip(length, gram, place, lead, context, item_lead, item_context, strict=True):
        x, y, back, on = mine.split(" "), theirs.split(" "), 0, 0
        while back < min(a, b) and x[a - back - 1] == y[b - back - 1]:
            back += 1
        while on < min(len(x) - a, len(y) - b) and x[a + on] == y[b + on]:
            on += 1
        out.append((p - back, p + on) if on >= k and back + on >= n else (None, None))
    return pd.DataFrame(out, columns=["lo", "hi"]).astype("Int32")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counted, hits, matches): counted(doc_id, text_hash, n_words) for every row; hits(doc_id, text_hash, spans), the
    word spans that lie in an occurrence of an item's window; matches(doc_id, text_hash, item_id).

    A document and an item that share a window of w words have the same smallest k-gram hash in it, so both keep it,
    and comparing words outward from there finds the whole window: no shared window is missed, and none is reported
    without its words being equal. Windows have ``window`` words, or all words of a shorter item.

    A null text has no words, an item without words matches nothing, a null item_id counts as an empty name; rows
    that repeat a document are found alike. Items of equal words are fingerprinted once, and an item_id that stands on
    several rows is one item with the windows of all of them. Empty tables give no hits.
    """
    spelled = F.trim(F.regexp_replace(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    items = cut(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), spelled.alias("text")).where("text <> ''"))
    kinds = items.select("text", F.sha2("text", 256).alias("kind")).distinct()
    known = cut(_scan(kinds, [], gram, own=window).where("hash is not null").select(
        "kind", "length", "hash", F.col("lead").alias("item_lead"), F.col("context").alias("item_context")).distinct())
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())        # at most ``window`` of them
    sent = None
    if within(known, most_sent):
        rows = known.select("length", "hash").distinct().toPandas()
        sent = docs.sparkSession.sparkContext.broadcast({n: np.sort(rows.loc[rows["length"] == n, "hash"].to_numpy(np.int64).view(np.uint64)) for n in lengths})
    found = cut(_scan(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), lengths, gram, sent))
    counted = found.where("n_words is not null").select("doc_id", "text_hash", "n_words")
    side = F.broadcast(known) if within(known, 20_000) else known
    both = found.where("hash is not null").join(side, ["length", "hash"])
    k = F.least(F.col("length"), F.lit(gram))
    runs = both.withColumn("run", extended("length", k, "place", "lead", "context", "item_lead", "item_context")).where("run.lo is not null")
    runs = cut(runs.select("doc_id", "text_hash", "kind", "run.lo", "run.hi"))
    # runs that overlap or touch in one document become one span
    ordered = F.array_sort(F.collect_set(F.struct("lo", "hi")))
    merged = F.aggregate("runs", F.array().cast("array<struct<lo:int,hi:int>>"), lambda acc, r: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] >= r["lo"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], r["hi"]).alias("hi"))))
    ).otherwise(F.concat(acc, F.array(r))))
    hits = runs.groupBy("doc_id", "text_hash").agg(ordered.alias("runs")).select("doc_id", "text_hash", merged.alias("spans"))
    names = items.select("item_id", F.sha2("text", 256).alias("kind"))
    matches = runs.select("doc_id", "text_hash", "kind").distinct().join(names, "kind").select("doc_id", "text_hash", "item_id")
    return counted, hits, matches


def judged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    counted, hits, matches = contamination(docs, benchmark, **options)
    words_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["hi"] - s["lo"])
    h = hits.select(F.struct("doc_id", "text_hash").alias("k"), words_hit.cast("long").alias("n_hit"))
    m = matches.groupBy(F.struct("doc_id", "text_hash").alias("k")).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    both = h.join(m, "k")
    all_of = counted.withColumn("k", F.struct("doc_id", "text_hash")).join(both, "k", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return all_of.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                         F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    bad = judged(docs, benchmark, **options).where("contaminated").select(F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).alias("__bad")).distinct()
    own = F.struct(docs["doc_id"].alias("d"), F.xxhash64(docs["text"]).alias("t"))
    return docs.join(bad, own == F.col("__bad"), "left_anti")


_SQL = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
           FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w
      FROM documents),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, ns)),
h AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""


@query("op2_winnow_decontamination", _SQL)
def op2(spark: SparkSession, path: str) -> DataFrame:
    return judged(table(spark, path, "documents"), table(spark, path, "benchmark")).drop("text_hash")
