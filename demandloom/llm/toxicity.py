"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .registry import query

WORD = re.compile(r"[^\W\d_]+")
#: Words of one chain; a text is cut into chains of so many words, the last one shorter.
CHAIN = 64
#: Bounds of what a model is fitted on: labelled documents (by hash of their id), and chains without a toxic word.
MOST_DOCUMENTS, MOST_CLEAN_CHAINS = 4000, 8000
#: Evidence (log likelihood ratio) and purity that make a feature a telltale of toxic documents.
EVIDENCE, PURITY = 18.0, 0.98
#: Features seen in fewer documents of the sample are not used.
LEAST_DOCUMENTS = 3
_KNOWN_WORDS, _TOKENS_AT_ONCE = 500_000, 100_000
#: Texts of an Arrow batch that are Python strings at a time.
_TEXTS_AT_ONCE = 256


def features(word: str) -> set[str]:
    """The word and its letter runs of 3 to 5, with marked ends, in lower case."""
    w = f"^{word.lower()}$"
    return {w} | {w[i:i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}


@dataclass
class Model:
    """Weights of the toxic state by feature, its bias, log potentials of starts and moves (from, to)."""
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


class _Emissions(dict):
    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        v = self[word] = max(-30.0, min(30.0, self.model.emission(word)))
        return v


def _chains(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains of documents of ``counts`` words, longest first."""
    starts, lengths, at = [], [], 0
    for n in counts:
        own = np.arange(at, at + n, CHAIN)
        starts.append(own)
        lengths.append(np.minimum(CHAIN, at + n - own))
        at += n
    s, n = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*lengths, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    return s[order], n[order]


def forward_backward(emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of the toxic state for each word, expected counts of moves), all chains side by side.

    Chains come longest first; messages are scaled to sum to 1 at every step.
    """
    n, most = len(emissions), int(lengths[0]) if len(lengths) else 0
    live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(most)]           # chains longer than t
    states = np.stack([np.exp(np.minimum(0.0, -emissions)), np.exp(np.minimum(0.0, emissions))], 1)
    step, forward, backward = np.exp(moves), np.empty((n, 2)), np.ones((n, 2))
    for t in range(most):
        at = starts[:live[t]] + t
        a = (np.exp(start) if t == 0 else forward[at - 1] @ step) * states[at]
        forward[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(most - 1, 0, -1):
        at = starts[:live[t]] + t
        onward = states[at] * backward[at]
        pair = forward[at - 1][:, :, None] * step * onward[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        b = onward @ step.T
        backward[at - 1] = b / b.sum(1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(1), expected


def fit(texts: list[str], toxic: np.ndarray, most_clean_chains: int = MOST_CLEAN_CHAINS, rounds: int = 50, ridge: float = 1e-4) -> Model:
    """Fit a model to whole texts and their labels.

    Words are labelled first: a feature is a telltale if nearly all documents that have it are toxic and there are
    enough of them to rule out chance (documents that share most word triples with earlier ones don't count, or rare
    words of a group of copies would tell); a word of a toxic document with a telltale is a toxic word. The field is
    then fitted to these words by gradient steps on its conditional likelihood: chains with toxic words, up to
    ``most_clean_chains`` others, and every other word of a clean document once, as a chain of its own. Without
    toxic words the model calls nothing toxic.
    """
    spelled = [WORD.findall(t.lower()) for t in texts]
    ids: dict[str, int] = {}
    docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws)) for ws in spelled]
    names: dict[str, int] = {}
    own = [np.fromiter((names.setdefault(f, len(names)) for f in sorted(features(w))), np.int64) for w in ids]
    seen, count, triples = np.zeros((2, len(names)), np.int64), np.zeros(2), set()
    for d, t in zip(docs, toxic.tolist(), strict=True):
        three = d[:-2] + 1_000_003 * d[1:-1] + 998_244_353 * d[2:]
        three = set(three[three % 4 == 0].tolist())              # a quarter of the triples tells copies as well
        if len(d) and 2 * len(three & triples) <= len(three):
            triples |= three
            count[int(t)] += 1
            seen[int(t), np.unique(np.concatenate([own[i] for i in np.unique(d)]))] += 1
    share = count[1] / max(count.sum(), 1)
    if not 0 < share < 1:
        return Model()
    a, b = seen[1], seen[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a * np.log(a / (a + b) / share) + np.where(b > 0, b * np.log(b / (a + b) / (1 - share)), 0.0)
    telltale = (np.nan_to_num(gain) >= EVIDENCE) & (a >= PURITY * (a + b))
    told = np.array([telltale[f].any() for f in own], bool)
    common = a + b >= LEAST_DOCUMENTS
    renamed = np.cumsum(common) - 1
    own, names = [renamed[f[common[f]]] for f in own], {f: int(renamed[i]) for f, i in names.items() if common[i]}
    chains, labels, clean = [], [], 0
    for d, t in zip(docs, toxic.tolist(), strict=True):
        for at in range(0, len(d), CHAIN):
            c = d[at:at + CHAIN]
            y = told[c] if t else np.zeros(len(c), bool)
            if not y.any():
                clean += 1
                if clean > most_clean_chains:
                    continue
            chains.append(c)
            labels.append(y)
    met = np.zeros(len(ids), bool)
    for c in chains:
        met[c] = True
    for d, t in zip(docs, toxic.tolist(), strict=True):
        rest = np.unique(d[~met[d]]) if not t else d[:0]
        met[rest] = True
        chains += np.split(rest, len(rest)) if len(rest) else []
        labels += [np.zeros(1, bool)] * len(rest)
    y = np.concatenate([*labels, np.zeros(0, bool)]).astype(float)
    if not y.any():
        return Model()
    used, word = np.unique(np.concatenate(chains), return_inverse=True)
    counts = [len(c) for c in chains]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    order = np.argsort(-np.array(counts), kind="stable")
    starts, lengths = first[order], np.array(counts)[order]
    flat = np.concatenate([own[i] for i in used]).astype(np.int32)
    owner = np.repeat(np.arange(len(used), dtype=np.int32), [len(own[i]) for i in used])
    size = len(names)
    theta, mean, square = np.zeros(size + 7), np.zeros(size + 7), np.zeros(size + 7)
    inner = np.concatenate([np.ones(0, np.int64), *[np.arange(s + 1, s + n) for s, n in zip(first, counts, strict=True)]]).astype(np.int64)
    z = y.astype(np.int64)
    observed = np.bincount(2 * z[inner - 1] + z[inner], minlength=4).reshape(2, 2)
    for k in range(1, rounds + 1):
        e = theta[size] + np.bincount(owner, theta[flat], len(used))
        p, expected = forward_backward(np.clip(e, -30, 30)[word], starts, lengths, theta[size + 1:size + 3], theta[size + 3:].reshape(2, 2))
        off = np.bincount(word, p - y, len(used))
        g = np.zeros(size + 7)
        g[:size] = np.bincount(flat, off[owner], size) + ridge * len(chains) * theta[:size]
        g[size] = off.sum()
        g[size + 2] = (p - y)[starts].sum()
        g[size + 1] = -g[size + 2]
        g[size + 3:] = (expected - observed).ravel()
        g /= len(chains)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta -= 0.1 * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
    keep = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 0.01}
    return Model(keep, float(theta[size]), theta[size + 1:size + 3].copy(), theta[size + 3:].reshape(2, 2).copy())


def tag(texts: list[str | None], model: Model, known: dict[str, float], cutoff: float = 0.5) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
    """For each text: its score, and its toxic spans (start, end, probability) in code points.

    A span is a run of words each likelier toxic than ``cutoff``. The score is the chance that any such word is toxic,
    or the largest single chance if no word passes; a text without words scores 0.
    """
    scores, spans, at = [], [], 0
    while at < len(texts):
        words, counts = [], []
        while at < len(texts) and (not words or len(words) < _TOKENS_AT_ONCE):
            own = WORD.findall(texts[at] or "")
            words += own
            counts.append(len(own))
            at += 1
        e = np.fromiter(map(known.__getitem__, words), float, len(words))
        p, _ = forward_backward(e, *_chains(counts), model.start, model.moves)
        ends = np.cumsum(counts)
        for i, (end, n) in enumerate(zip(ends.tolist(), counts, strict=True)):
            q = p[end - n:end]
            bad = np.flatnonzero(q >= cutoff)
            scores.append(float(1 - np.prod(1 - q[bad])) if len(bad) else float(q.max()) if n else 0.0)
            spans.append(_spans(texts[at - len(counts) + i], q, cutoff) if len(bad) else [])
    return scores, spans


def _spans(text: str, q: np.ndarray, cutoff: float) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    last = -2
    for i, (m, p) in enumerate(zip(WORD.finditer(text), q.tolist(), strict=True)):
        if p >= cutoff:
            out = [*out[:-1], (out[-1][0], m.end(), max(out[-1][2], p))] if last == i - 1 else [*out, (m.start(), m.end(), p)]
            last = i
    return out


_RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])))])


def toxic(text: Column, spark: SparkSession, model: Model) -> Column:
    """struct(score, spans) of a text column; a null text counts as empty."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def tagged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Emissions(sent.value)
        for batch in batches:
            scores, spans = [], []
            for at in range(0, len(batch), _TEXTS_AT_ONCE):
                s, x = tag(batch.slice(at, _TEXTS_AT_ONCE).to_pylist(), sent.value, known)
                scores += s
                spans += x
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            rows = pa.array([[{"start": s, "end": e, "p": p} for s, e, p in x] for x in spans], kind)
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), rows], names=["score", "spans"])
    return tagged(text)


def train(docs: DataFrame, labels: DataFrame, most_documents: int = MOST_DOCUMENTS, **options) -> Model:
    """Fit to at most ``most_documents`` of the labelled documents (labels: doc_id, toxic), chosen by a hash of their id.

    The sample is gathered and fitted in one task, whose size the bound fixes; the driver gets the model only.
    Null labels, ids and texts are left out.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_documents)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", "text", F.col("toxic").cast("double").alias("toxic"))

    def fitted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([*parts, pd.DataFrame({"doc_id": [], "text": [], "toxic": []})]).sort_values(["doc_id", "text", "toxic"])
        yield pd.DataFrame({"model": [pickle.dumps(fit(sample["text"].tolist(), sample["toxic"].to_numpy(float) > 0, **options))]})
    found = rows.repartition(1).mapInPandas(fitted, "model binary").collect()
    return pickle.loads(bytes(found[0][0])) if found else Model()


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score, spans) for every row of ``docs``; learns only from labels of documents that are not held out.

    Null and empty texts score 0. Rows that repeat are scored alike. An empty label table calls nothing toxic.
    """
    known = labels.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    model = train(docs, known, **options)
    return docs.select("doc_id", toxic(F.col("text"), docs.sparkSession, model).alias("t")).select("doc_id", "t.score", "t.spans")


def without_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, **options) -> DataFrame:
    """Rows of ``docs`` that score below ``cutoff``, with all their columns."""
    known = labels.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    model = train(docs, known, **options)
    return docs.where(toxic(F.col("text"), docs.sparkSession, model)["score"] < cutoff)


@query("op6_crf_toxicity")
def op6(spark: SparkSession, path: str) -> DataFrame:
    found = scored(table(spark, path, "documents"), table(spark, path, "labels"))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
