"""Quality by a sparse rule ensemble: tree paths as rules, lasso logistic weights, Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .registry import query

#: Bound of what a model is fitted on: labelled documents, by hash of their id.
MOST_DOCUMENTS = 8000


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; all are 0 for an empty one. A null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n, count = F.length(t), lambda pattern: F.regexp_count(t, F.lit(pattern))
    words = F.filter(F.split(t, r"[\x00-\x20]+"), lambda w: w != "")
    return {"chars": n, "words": F.size(words), "kinds": F.size(F.array_distinct(words)), "lines": count("\n"), "upper": count(r"\p{Lu}"), "digits": count("[0-9]"),
            "stops": count(r"[.?!](?=[\x00-\x20]|$)"), "marks": count(r"[!-/:-@\[-`{-~]"), "odd": count(r"[#$%&*+/<=>@\\^_|~{}\[\]]"), "shouts": count("!!"), "runs": count(r"(.)\1\1")}


def ratios() -> dict[str, Column]:
    """What rules look at, from the columns of ``statistics``."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {"chars": F.col("chars").cast("double"), "words": F.col("words").cast("double"), "fresh": per("kinds", "words"), "word_length": per("chars", "words"),
            "line_length": F.col("words") / (F.col("lines") + 1), "stop_length": F.col("words") / (F.col("stops") + 1), "upper": per("upper", "chars"), "digits": per("digits", "chars"),
            "marks": per("marks", "words"), "odd": per("odd", "words"), "shouts": per("shouts", "words"), "runs": per("runs", "words")}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, threshold), and its weight."""
    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.tests:
            out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """The probability of label 1 as a column over the ``ratios``."""
        z = F.lit(self.bias)
        for r in self.rules:
            z = z + F.when(r.column(), r.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, trees: int, depth: int, cuts: int = 24) -> list[tuple]:
    """Paths of boosted regression trees (each on half of the rows and features) as sets of tests."""
    score, found = np.full(len(y), y.mean()), {}
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 2)[1:-1])) for j in range(x.shape[1])]

    def split(rows: np.ndarray, cols: np.ndarray, tests: tuple, left: int) -> None:
        if tests:
            found.setdefault(frozenset(tests), tests)
        r = residual[rows]
        best, total, n = (1e-9, None, None), r.sum(), len(rows)
        for j in cols if left and n >= 20 else ():
            if not len(grid[j]):
                continue
            at = np.searchsorted(grid[j], x[rows, j], side="left")
            s, c = np.bincount(at, r, len(grid[j]) + 1).cumsum()[:-1], np.bincount(at, minlength=len(grid[j]) + 1).cumsum()[:-1]
            ok = (c >= 5) & (n - c >= 5)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, s * s / c + (total - s) ** 2 / (n - c) - total * total / n, 0.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, float(grid[j][k]))
        if best[1] is None:
            score[rows] += 0.1 * r.mean() * 4
            return
        below = x[rows, best[1]] <= best[2]
        for above, part in ((False, rows[below]), (True, rows[~below])):
            split(part, cols, (*tests, (names[best[1]], above, best[2])), left - 1)

    for _ in range(trees):
        residual = y - np.clip(score, 0, 1)
        rows = rng.permutation(len(y))[:max(len(y) // 2, 20)]
        split(rows, rng.permutation(x.shape[1])[:max(x.shape[1] // 2, 2)], (), depth)
    return list(found.values())


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, lasso: float = 2e-3, rounds: int = 400, seed: int = 7) -> RuleEnsemble:
    """Grow trees, take every path as a rule, and fit lasso logistic weights by accelerated proximal steps.

    Without both labels the ensemble is a constant: the share of label 1, or one half if there are no rows.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(bias, ())
    paths = grow(x, y, names, np.random.default_rng(seed), trees, depth)
    at = {n: j for j, n in enumerate(names)}
    fires = np.stack([np.logical_and.reduce([x[:, at[n]] > v if up else x[:, at[n]] <= v for n, up, v in p]) for p in paths], 1).astype(np.float32)
    middle, spread = fires.mean(0), fires.std(0) + 1e-6
    z = (fires - middle) / spread
    w, v, b, vb, t = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), bias, bias, 1.0
    step = 4 * len(y) / float(np.linalg.norm(z, 2) ** 2 + len(y))
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - step * (z.T @ off) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        new_b, new_t = vb - step * off.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    kept = [Rule(p, float(k)) for p, k in zip(paths, w / spread, strict=True) if k]
    return RuleEnsemble(float(b - (w / spread) @ middle), tuple(kept))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold


def scored(docs: DataFrame, labels: DataFrame, most_documents: int = MOST_DOCUMENTS, **options) -> tuple[DataFrame, RuleEnsemble]:
    """((doc_id, score) for every row of ``docs``, the ensemble); learns only from labels that are not held out.

    Statistics of whole texts are taken once, for all rows, and stored; the labelled sample (at most ``most_documents``,
    statistics only) is all that comes to the driver. Null labels and ids teach nothing, null texts count as empty,
    rows that repeat are scored alike, an empty label table scores everything 0.5.
    """
    stats = docs.select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    facts = cut(stats.select("doc_id", *[c.alias(n) for n, c in ratios().items()]))
    names = list(ratios())
    known = labels.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)) & F.col("quality").isNotNull()).select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_documents)
    rows = facts.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "quality", *names])
    model = fit(rows[names].to_numpy(float), rows["quality"].to_numpy(float), names, **options)
    return facts.select("doc_id", model.column().alias("score")), model


@query("op5_rule_quality")
def op5(spark: SparkSession, path: str) -> DataFrame:
    found, _ = scored(table(spark, path, "documents"), table(spark, path, "labels"))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
