"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import table
from .registry import query

#: Samples of a fingerprint; each is kept as 16 bits (4 hex digits).
SAMPLES = 64
_KNOWN_TERMS, _TERMS_AT_ONCE = 120_000, 20_000


def terms(text: str | None) -> Counter:
    """Words (between white space, A-Z lower-cased) and how often each occurs: its weight."""
    return Counter((text or "").encode().lower().split())


def _mix(z: np.ndarray) -> np.ndarray:
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _uniforms(hashes: np.ndarray, samples: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each term and sample."""
    salt = _mix(np.arange(1 + stream * samples, 1 + (stream + 1) * samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = _mix(hashes[:, None] ^ salt[None, :])
    scale = np.float32(2.0 ** -24)
    return ((z >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * scale, ((z & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale


class Sampler:
    """Gamma(2, 1) variables r and c and a shift b for every term and sample, made from the term's hash.

    For weight w: t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)); of all terms of a document, the one
    of the smallest a is the sample, with its t. Two documents agree in a sample with the probability of their
    generalised Jaccard likeness, the sum of smaller weights over the sum of larger ones. Variables of recent terms are
    kept, up to a fixed number.
    """

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        self.known: dict[bytes, int] = {}
        self.hashes = np.empty(_KNOWN_TERMS + _TERMS_AT_ONCE, np.uint64)
        self.r, self.log_c, self.b, self.once = (np.empty((len(self.hashes), samples), np.float32) for _ in range(4))
        self.places = np.arange(samples)

    def _learn(self, wanted: list[bytes]) -> None:
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > _KNOWN_TERMS:
            self.known, new = {}, wanted
        if len(new) > len(self.hashes):                         # one very long text
            more = len(new)
            self.hashes = np.empty(more, np.uint64)
            self.r, self.log_c, self.b, self.once = (np.empty((more, self.samples), np.float32) for _ in range(4))
        start = len(self.known)
        self.known.update((w, start + i) for i, w in enumerate(new))
        self.hashes[start:start + len(new)] = np.fromiter((xxh64_intdigest(w) for w in new), np.uint64, len(new))
        for at in range(start, start + len(new), 512):          # small enough for the processor's cache
            h = self.hashes[at:min(at + 512, start + len(new))]
            own = slice(at, at + len(h))
            u1, u2 = _uniforms(h, self.samples, 0)
            u3, u4 = _uniforms(h, self.samples, 1)
            u5, _ = _uniforms(h, self.samples, 2)
            self.r[own], self.log_c[own], self.b[own] = -np.log(u1 * u2), np.log(-np.log(u3 * u4)), u5
            self.once[own] = self.log_c[own] + self.r[own] * (u5 - 1)          # log a of weight 1, where t = 0

    def _sample(self, bag: Counter) -> np.ndarray:
        if not bag:
            return np.zeros(self.samples, np.uint16)
        at = np.fromiter(map(self.known.__getitem__, bag), np.int64, len(bag))
        weights = np.fromiter(bag.values(), np.int64, len(bag))
        log_a = self.once[at]
        more = np.flatnonzero(weights > 1)
        if len(more):
            own = at[more]
            r, b = self.r[own], self.b[own]
            steps = np.floor(np.log(weights[more].astype(np.float32))[:, None] / r + b)
            log_a[more] = self.log_c[own] - r * (steps - b) - r
        best = np.ascontiguousarray(log_a.T).argmin(1)
        z = self.hashes[at[best]]
        if len(more):
            row = np.full(len(bag), -1)
            row[more] = np.arange(len(more))
            level = np.where(row[best] >= 0, steps[row[best], self.places], 0.0)
            z = z ^ (level.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.maximum(_mix(z) >> np.uint64(48), np.uint64(1)).astype(np.uint16)

    def fingerprints(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        bags, wanted = [], {}
        for text in [*texts, None]:
            if len(wanted) > _TERMS_AT_ONCE or len(out) + len(bags) == len(texts):
                self._learn(list(wanted))
                out += [self._sample(b) for b in bags]
                bags, wanted = [], {}
            if len(out) + len(bags) < len(texts):
                bags.append(terms(text))
                wanted |= dict.fromkeys(bags[-1])
        return out


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints, between 0 and 1."""
    same = lambda i: (F.substring(a, 4 * i + 1, F.lit(4)) == F.substring(b, 4 * i + 1, F.lit(4))).cast("int")
    return F.when(a == b, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, i: n + same(i)) / samples)


def fingerprint(*texts: Column, samples: int = SAMPLES) -> Column:
    """struct of the fingerprints (f0, f1, ...) of text columns as hex; those of equal texts are equal.

    A null text counts as empty. Texts without words have the fingerprint of zeros, which no other text has.
    """
    kind = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(texts))])

    @F.arrow_udf(kind)
    def made(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        sampler = Sampler(samples)
        for batch in batches:
            cols = [list(c.to_pylist()) for c in (batch if isinstance(batch, tuple) else (batch,))]
            n = len(cols[0])
            found = sampler.fingerprints([c[i] for i in range(n) for c in cols])      # a row's texts share most terms
            hexed = [text_of(f) for f in found]
            yield pa.StructArray.from_arrays([pa.array(hexed[j::len(cols)], pa.string()) for j in range(len(cols))], names=kind.names)
    return made(*texts)


LAST = (1 << 63) - 1


def with_next(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """(rows, window): each row (doc_id, text, place...) of ``docs`` beside those of ascending doc_id.

    Ids are cut into ranges of about equal counts, one window each. The first row of a range is sent to the range
    before it too (that of the first to the last), with own = false, so that ``lead`` over the window finds the next
    document of every own row; texts are shuffled once. Ties go by a hash of the text, a null id comes last.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"))
    edges = rows.agg(F.percentile_approx("ord", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    edges = sorted(set(edges))
    low = F.lit(0) if not edges else F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("ord")))
    rows = rows.withColumn("bucket", low).withColumn("tie", F.xxhash64("text"))
    firsts = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.min(F.struct("ord", "tie")).alias("f")).select("bucket", "f.ord", "f.tie").collect())   # a row a bucket
    heads = F.lit(None).cast("int")
    if firsts:
        before = {b: firsts[i - 1][0] for i, (b, _, _) in enumerate(firsts)}
        pick = lambda values: F.create_map(*[F.lit(x) for kv in values for x in kv])[F.col("bucket")]
        head = (F.col("ord") == pick([(b, o) for b, o, _ in firsts])) & (F.col("tie") == pick([(b, t) for b, _, t in firsts]))
        heads = F.when(head, pick(list(before.items())))
    places = F.array(F.struct(F.col("bucket").alias("at"), F.lit(True).alias("own")), F.struct(heads.alias("at"), F.lit(False).alias("own")))
    spread = rows.select("doc_id", "text", "ord", "tie", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("p")).select("doc_id", "text", "ord", "tie", "p.at", "p.own")
    return spread, Window.partitionBy("at").orderBy(F.col("own").desc(), "ord", "tie")


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the start of the next document instead of its own last quarter. One document is
    next to itself; an empty table gives no rows; empty texts are like each other and like nothing else.
    """
    rows, window = with_next(docs)
    n = F.length("text")
    cutoff = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cutoff), F.substring(F.coalesce(F.lead("text").over(window), F.lit("")), F.lit(1), cutoff))
    both = rows.select("doc_id", "text", "ord", "tie", "at", "own", edited.alias("edited"))
    made = both.select("doc_id", "ord", "tie", "at", "own", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), F.col("edited"), samples=samples).alias("f"))
    made = made.select("doc_id", "ord", "tie", "at", "own", "n_chars", "edited_sha256", F.col("f.f0").alias("fingerprint"), F.col("f.f1").alias("edited_fingerprint"))
    made = made.withColumn("next", F.lead("fingerprint").over(window)).where("own")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next"), samples).alias("near_next"))


@query("op4_weighted_fingerprints")
def op4(spark: SparkSession, path: str) -> DataFrame:
    return compared(table(spark, path, "documents"))
