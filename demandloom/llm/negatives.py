"""Hard negatives by secondary sort: scored pairs arrive by anchor and falling score, and windows open and close as they pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .registry import query

#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows that a cell's anchors meet at a time, and anchors scored at a time (16 MB of scores).
ROWS, SCORED = 4096, 512
#: Anchors of a cell, in number and in bytes of their vectors.
ANCHORS, ANCHOR_BYTES = 65_536, 1 << 25

_VECTOR = "vec_id bigint, label int, vector binary"


def vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, each component x as floor(scale * x) in 64-bit integers, packed.

    A row with a null vec_id, label or vector, or any null or non-finite component, takes no part. Rows that repeat a vec_id are
    one row: the one of the least label, then the least packed vector.
    """
    x = F.col("embedding")
    plain = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & plain)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            flat = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            flat = np.clip(flat, -2.0 ** 62, 2.0 ** 62).astype("<i8")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy(zero_copy_only=False))]).astype(np.int64)
            packed = [flat[ends[i]:ends[i + 1]].tobytes() for i in range(len(col))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(packed, pa.binary())], names=["vec_id", "label", "vector"])
    packed = kept.mapInArrow(pack, _VECTOR)
    return packed.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers; a shorter vector ends in zeros."""
    if all(len(v) == 8 * width for v in packed):
        return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), width)
    out = np.zeros((len(packed), width), np.int64)
    for i, v in enumerate(packed):
        one = np.frombuffer(v, "<i8")
        out[i, :len(one)] = one
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of all anchors with all rows; doubles are used while they are exact."""
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(anchors.shape[1], 1)
    if most < 2 ** 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


class Firsts:
    """The first ``most`` rows of each window of each anchor, as blocks of rows pass: higher scores, then smaller ids.

    An anchor's windows are score ranges [low, high]; ``same`` takes other rows of the anchor's label, else rows of other labels.
    A window that is full only takes what comes before its last, so its floor rises.
    """
    def __init__(self, who: np.ndarray, what: np.ndarray, packed: list[bytes], low: np.ndarray, high: np.ndarray, same: bool, most: int):
        self.who, self.what, self.same, self.most, self.high, self.floor = who, what, same, most, high, low.copy()
        self.vectors = matrix(packed, max(map(len, packed), default=0) // 8)
        self.n = np.zeros(low.shape, np.int64)
        self.score, self.id = np.zeros((*low.shape, most), np.int64), np.zeros((*low.shape, most), np.int64)

    def meet(self, ids: np.ndarray, labels: np.ndarray, packed: list[bytes]) -> None:
        width = self.vectors.shape[1]
        rows = matrix(packed, max(map(len, packed), default=0) // 8)[:, :width]         # beyond, the anchors end in zeros
        for k in range(0, len(self.who), SCORED):
            part = slice(k, k + SCORED)
            s = scores(self.vectors[part, :rows.shape[1]], rows)
            alike = self.what[part, None] == labels
            fit = alike & (self.who[part, None] != ids) if self.same else ~alike
            for w in range(self.high.shape[1]):
                inside = fit & (s >= self.floor[part, w, None]) & (s <= self.high[part, w, None])
                if np.count_nonzero(inside) > 8 * self.most * len(s):
                    edge = np.partition(np.where(inside, s, np.iinfo(np.int64).min), -self.most, axis=1)[:, -self.most]
                    inside &= s >= edge[:, None]
                at, col = np.nonzero(inside)
                self._add(at + k, w, s[at, col], ids[col])

    def _add(self, k: np.ndarray, w: int, score: np.ndarray, ids: np.ndarray) -> None:
        before = (self.n[k, w] < self.most) | (score > self.floor[k, w]) | (ids < self.id[k, w, -1])
        k, score, ids = k[before], score[before], ids[before]
        if not len(k):
            return
        own = np.unique(k)
        old, place = np.nonzero(np.arange(self.most) < self.n[own, w, None])
        k, score, ids = np.concatenate([k, own[old]]), np.concatenate([score, self.score[own[old], w, place]]), np.concatenate([ids, self.id[own[old], w, place]])
        order = np.lexsort((ids, -score, k))
        k, score, ids = k[order], score[order], ids[order]
        rank = np.arange(len(k)) - np.searchsorted(k, k)
        first = rank < self.most
        self.score[k[first], w, rank[first]], self.id[k[first], w, rank[first]] = score[first], ids[first]
        self.n[own, w] = np.minimum(np.searchsorted(k, own, "right") - np.searchsorted(k, own), self.most)
        full = own[self.n[own, w] == self.most]
        self.floor[full, w] = self.score[full, w, -1]

    def pairs(self) -> pa.RecordBatch:
        """(anchor_id, score, other, kind) of all that is held; what several windows of an anchor hold, once."""
        k, w, place = np.nonzero(np.arange(self.most) < self.n[:, :, None])
        score, ids = self.score[k, w, place], self.id[k, w, place]
        order = np.lexsort((ids, k))
        k, score, ids = k[order], score[order], ids[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (ids[1:] != ids[:-1])
        kind = np.full(int(new.sum()), 0 if self.same else 1, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(self.who[k[new]], pa.int64()), pa.array(score[new], pa.int64()), pa.array(ids[new], pa.int64()), pa.array(kind)],
                                          names=["anchor_id", "score", "other", "kind"])


def _grid(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every anchor beside every row, once: (cell, asks, vec_id, label, vector, scores), a cell in one task, its anchors first.

    A cell has ANCHORS anchors or ANCHOR_BYTES of them at most (a few more by chance) and a slice of the rows: as many slices as the
    session has tasks, but not more than leave a slice as many rows as the cell has anchors, so that copies of anchors don't outgrow the rows.
    """
    n, size = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("vector")), F.lit(0))).first()
    blocks = max(1, -(-n // ANCHORS), -(-size // ANCHOR_BYTES))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, min(-(-tasks // blocks), rows.count() * blocks // max(n, 1)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))                              # noqa: E731
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))                       # noqa: E731
    cell = (F.col("block") * slices + F.col("slice")).cast("int").alias("cell")
    asked = F.col("scores") if "scores" in anchors.columns else F.lit(None).cast("array<bigint>")
    a = anchors.select("*", deal(blocks).alias("block"), each(slices).alias("slice")).select(cell, F.lit(0).alias("asks"), "vec_id", "label", "vector", asked.alias("scores"))
    r = rows.select("*", deal(slices).alias("slice"), each(blocks).alias("block")).select(cell, F.lit(1).alias("asks"), "vec_id", "label", "vector", F.lit(None).cast("array<bigint>").alias("scores"))
    return a.unionByName(r).repartitionById(blocks * slices, "cell").sortWithinPartitions("cell", "asks")


def _met(made, at_once: int):
    """Rows of a cell pass its anchors; ``made`` takes the anchors' rows and gives their Firsts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, firsts = None, [], None
        for b in batches:
            cell, asks = b.column("cell").to_numpy(), b.column("asks").to_numpy()
            ends = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *ends], [*ends, len(b)], strict=True):
                if i == j:
                    continue
                if cell[i] != now:
                    if firsts is not None:
                        yield firsts.pairs()
                    now, held, firsts = cell[i], [], None
                if not asks[i]:
                    held.append(b.slice(i, j - i))
                    continue
                if held and firsts is None:
                    firsts, held = made(pa.Table.from_batches(held)), [None]
                for k in range(i, j, at_once) if firsts is not None else ():
                    part = b.slice(k, min(at_once, j - k))
                    firsts.meet(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), part.column("vector").to_pylist())
        if firsts is not None:
            yield firsts.pairs()
    return run


def _window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


_PAIR = "anchor_id bigint, score bigint, other bigint, kind int"


def _sorted(pairs: DataFrame) -> DataFrame:
    """Secondary sort: pairs dealt by anchor, in each task by anchor, falling score, positives first, id."""
    return pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "kind", "other")


def positives(anchors: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(vec_id, ids, scores): each anchor's first ``most`` other rows of its label."""
    def made(a: pa.Table) -> Firsts:
        n, ends = len(a), np.iinfo(np.int64)
        return Firsts(a["vec_id"].to_numpy(), a["label"].to_numpy(), a["vector"].to_pylist(), np.full((n, 1), ends.min), np.full((n, 1), ends.max), True, most)

    def first(batches):
        now, ids, sc = None, [], []
        done: tuple[list, list, list] = ([], [], [])
        for b in batches:
            for anchor, score, other in zip(*(b.column(c).to_pylist() for c in ("anchor_id", "score", "other")), strict=True):
                if anchor != now:
                    if now is not None:
                        [x.append(y) for x, y in zip(done, (now, ids, sc), strict=True)]
                    now, ids, sc = anchor, [], []
                if len(ids) < most:
                    ids.append(other)
                    sc.append(score)
        if now is not None:
            [x.append(y) for x, y in zip(done, (now, ids, sc), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.list_(pa.int64())), pa.array(done[2], pa.list_(pa.int64()))], names=["vec_id", "ids", "scores"])
    pairs = _grid(anchors, rows).mapInArrow(_met(made, ROWS), _PAIR)
    return _sorted(pairs).mapInArrow(first, "vec_id bigint, ids array<bigint>, scores array<bigint>")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows(vec_id, label, vector).

    The anchors' positives are found first. Every cell of anchors and rows then sends, for each anchor, the rows of another label that are
    among the cell's first ``n_negatives`` inside the window of some positive: a row that is not cannot be among the first of all.
    These pairs and the positives travel under the key (anchor, falling score, positive first, id); a task reads its part of the
    sorted stream once, opens a window when a positive passes, and gives each negative to the open windows that it lies in. It
    holds one anchor's windows, never its pairs.

    An anchor without another row of its label, and a positive with no row in its window (always so for a score below 0), has no
    rows. Equal scores go by the smaller id. Scores are 64-bit integers and wrap beyond. Vectors of unequal length are compared as if the shorter ended in zeros. An empty
    table gives no rows.
    """
    rows = cut(rows)
    anchors = rows.where(is_anchor)
    known = cut(anchors.join(positives(anchors, rows, n_positives), "vec_id"))

    def made(a: pa.Table) -> Firsts:
        wins = [sorted({_window(p, low, high) for p in ps}) for ps in a["scores"].to_pylist()]
        bounds = np.array([[*w, *[(1, 0)] * (n_positives - len(w))] for w in wins], np.int64).reshape(len(wins), n_positives, 2)      # (1, 0) holds nothing
        return Firsts(a["vec_id"].to_numpy(), a["label"].to_numpy(), a["vector"].to_pylist(), bounds[:, :, 0], bounds[:, :, 1], False, n_negatives)

    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def windows(batches):
        now, held = None, []                              # the windows of one anchor: [positive, score, given, from, to]
        for b in batches:
            out: list[tuple] = []
            for anchor, score, other, kind in zip(*(b.column(c).to_pylist() for c in ("anchor_id", "score", "other", "kind")), strict=True):
                if anchor != now:
                    now, held = anchor, []
                if kind == 0:
                    held.append([other, score, 0, *_window(score, low, high)])
                    continue
                for w in held:
                    if w[2] < n_negatives and w[3] <= score <= w[4]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], other, w[1], score))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)
    near = known.select(F.col("vec_id").alias("anchor_id"), F.explode(F.arrays_zip("ids", "scores")).alias("p")).select(
        "anchor_id", F.col("p.scores").alias("score"), F.col("p.ids").alias("other"), F.lit(0).alias("kind"))
    far = _grid(known, rows).mapInArrow(_met(made, ROWS), _PAIR)
    return _sorted(far.union(near)).mapInArrow(windows, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op11_hard_negatives", _SQL)
def op11(spark: SparkSession, path: str) -> DataFrame:
    rows = vectors(table(spark, path, "embeddings")).withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mine(rows, F.col("vec_id") % 100 == 0)
