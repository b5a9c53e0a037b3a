"""Ranked lexical search, reversed: the items wait in an inverted index, the documents are streamed through it."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, table
from .registry import query

#: Documents returned for an item.
TOP = 10
#: Postings (an item and one of its terms) of one broadcast index, about 60 bytes each; further items go to further indexes, each
#: with a pass of its own over the documents' counts. An item is never split, so an index holds at least one.
MOST_POSTINGS = 1_000_000

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z is lower-cased."""
    return (text or "").encode().translate(_KEEP).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of the rows of an item_id."""
    def spell(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts:
            found = [sorted({t.decode() for t in terms(x)}) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())),
                                              pa.array([t for f in found for t in f], pa.string())], names=["item_id", "term"])
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(spell, f"item_id {kind}, term string").distinct()


def _blocks(postings: DataFrame, most: int, depth: int = 0) -> list[DataFrame]:
    """The postings in parts of whole items, of at most ``most`` rows unless one item has more."""
    total, items = postings.agg(F.count(F.lit(1)), F.count_distinct(F.struct("item_id"))).first()
    if total <= most or items < 2:
        return [postings] if total else []
    # items are dealt by hash to parts of half the bound on average; a part that is still too large is dealt again
    parts = max(2, math.ceil(2 * total / most))
    dealt = cut(postings.withColumn("part", F.pmod(F.xxhash64("item_id", F.lit(depth)), F.lit(parts)).cast("int")))
    return [b for i in range(parts) for b in _blocks(dealt.where(F.col("part") == i).select("item_id", "term"), most, depth + 1)]


def _counts(docs: DataFrame, known) -> DataFrame:
    """Per document with a term: (doc_id, n, ids, tfs), the numbers of the wanted terms it holds and how often; n counts all its terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            at, n, ids, tfs = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = terms(text)
                if words:
                    held = Counter(filter(number.__contains__, words))
                    at.append(i)
                    n.append(len(words))
                    ids.append(np.fromiter((number[w] for w in held), np.int32, len(held)))
                    tfs.append(np.fromiter(held.values(), np.int64, len(held)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "tfs"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n bigint, ids array<int>, tfs array<bigint>")


class _Least:
    """A doc_id whose order is turned round, so that a heap's least entry is the one that ranks last; null ranks after all."""
    __slots__ = ("key",)

    def __init__(self, key):
        self.key = key

    def __lt__(self, other):
        return other.key is not None and (self.key is None or other.key < self.key)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item, best first, ties by smaller doc_id.

    One pass counts the items' terms in every document and writes them; the sums over it give each term's weight. The second pass
    streams those counts through an inverted index of the items (broadcast, bounded by ``most_postings``): a document touches only
    the items that share a term, and each task keeps a heap of ``top`` documents for an item. The heaps are merged by a window.

    A null or empty text has no terms: such a document is not counted and not returned, such an item has no rows. Rows that repeat
    a document are documents of their own. Rows of one item_id are one item with the terms of all; a null item_id is an item.
    A null doc_id ranks last among equal scores. Empty tables give no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    postings = cut(_item_terms(items))
    kinds = {"item_id": items.schema["item_id"].dataType.simpleString(), "doc_id": docs.schema["doc_id"].dataType.simpleString()}
    out = spark.createDataFrame([], f"item_id {kinds['item_id']}, score bigint, doc_id {kinds['doc_id']}")
    for part in _blocks(postings, most_postings):
        held = part.orderBy("term", "item_id").toPandas()                  # at most most_postings rows, or one item
        names, number = np.unique(held["term"].to_numpy(object), return_inverse=True)
        counted = cut(_counts(docs, spark.sparkContext.broadcast({t.encode(): i for i, t in enumerate(names)})))
        total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        n_docs, n_terms = total[0], total[1] or 0
        df = np.zeros(len(names), np.int64)
        for i, n in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():                 # one row a term
            df[i] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        owners, owner = [], np.zeros(len(held), np.int64)
        place: dict = {}
        for k, x in enumerate(held["item_id"].astype(object).where(held["item_id"].notna(), None)):
            owner[k] = place.setdefault(x, len(place))
        owners = list(place)
        order = np.argsort(number, kind="stable")
        start = np.searchsorted(number[order], np.arange(len(names) + 1))
        index = spark.sparkContext.broadcast((weight, start, owner[order], owners))
        out = out.unionByName(counted.mapInArrow(_scored(index, [to_arrow_type(f.dataType) for f in out.schema.fields], n_docs, n_terms, top), out.schema))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))


def _scored(index, kinds: list[pa.DataType], n_docs: int, n_terms: int, top: int):
    """A pass over term counts: the best documents of each item among those of a task."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, owner, owners = index.value
        heaps: list[list] = [[] for _ in owners]
        least = np.zeros(len(owners), np.int64)               # what a document must reach to enter a full heap
        acc, serial, read = np.zeros(len(owners), np.int64), 0, False
        for b in batches:
            read = True
            for doc, n, ids, tfs in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids"), b.column("tfs"), strict=True):
                ids, tfs = ids.values.to_numpy(zero_copy_only=False), tfs.values.to_numpy(zero_copy_only=False)
                if not len(ids):
                    continue
                m = 10 + 90 * n * n_docs // n_terms
                gain = weight[ids] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))
                size = start[ids + 1] - start[ids]
                first = np.cumsum(size) - size
                touched = owner[np.repeat(start[ids] - first, size) + np.arange(size.sum())]
                np.add.at(acc, touched, np.repeat(gain, size))
                for i in np.flatnonzero((acc >= least) & (acc > 0)).tolist():
                    entry = (int(acc[i]), _Least(doc), serial)
                    serial += 1
                    if len(heaps[i]) < top:
                        heapq.heappush(heaps[i], entry)
                    else:
                        heapq.heappushpop(heaps[i], entry)
                    if len(heaps[i]) == top:
                        least[i] = heaps[i][0][0]
                acc[touched] = 0
        if read:
            rows = [(o, s, d.key) for o, heap in zip(owners, heaps, strict=True) for s, d, _ in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["item_id", "score", "doc_id"])
    return score


_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), t AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM n),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM c GROUP BY 1), t),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))))::BIGINT AS score
      FROM b JOIN c USING (term) JOIN f USING (term) JOIN n USING (doc_id), t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op13_reversed_search", _SQL)
def op13(spark: SparkSession, path: str) -> DataFrame:
    return rank(table(spark, path, "documents"), table(spark, path, "benchmark"))
