"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ranked, table
from .registry import query

#: A source may be taken this many times over, and so may any of its documents.
MOST = 3
#: Parts of a group of documents of one source and one size; each part is numbered by itself.
PARTS = 64


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size): the words of each text; a null text has none."""
    return docs.select(*more, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def cycle_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources(source, ...) with a weight each: ``weights`` in turn, by code point of the name, null last."""
    at = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    return ranked(sources, F.col("source").asc_nulls_last()).withColumn("weight", F.array(*map(F.lit, map(float, weights)))[at]).drop("rank")


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """Add ``target`` to sources(source, source_size, weight): shares of the sum of all sizes by weight, none above
    ``most`` times its source's size; what is cut there is shared out again by weight.

    Each round is one aggregate; the level (words for each unit of weight) only rises, so the sources that are full
    only get more and the rounds end.
    """
    level, full, limit = 0.0, -1, most * F.col("source_size")
    while True:
        over = F.col("weight") * level > limit
        n, room, weight, total = sources.agg(F.count_if(over), F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        if n == full or not total or not weight:
            break
        level, full = (total - room) / weight, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), limit.cast("double")))


def balance(hist: DataFrame, goals: DataFrame, most: float = MOST, tolerance: float = 1e-9, rounds: int = 80) -> DataFrame:
    """Rates of entropy balancing: (source, size, n, rate).

    hist(source, size, n) counts documents; goals(source, source_size, target). Among rates r between 0 and ``most``
    with sum(n * size * r) = target for each source, the ones nearest to 1 in entropy, sum(n * (r ln r - r)), are
    r = min(most, exp(tilt * size / scale)). The dual is convex with one tilt for each source: every round is one
    distributed aggregate, a Newton step on the logarithm of the words, and a halving of the bracket if the step
    leaves it. Sources settle side by side; the driver sees only the largest gap.
    """
    scale = F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))
    least = F.min(F.when(F.col("size") > 0, F.col("size")))
    shape = hist.groupBy("source").agg(F.coalesce(scale, F.lit(1.0)).alias("scale"), F.coalesce(least, F.lit(1)).alias("least")).withColumnRenamed("source", "__s")
    state = goals.join(shape, goals["source"].eqNullSafe(F.col("__s"))).drop("__s")
    low = F.when(F.col("target") > 0, F.least(F.lit(0.0), F.log(F.col("target") / F.greatest("source_size", F.lit(1))) * F.col("scale") / F.col("least"))).otherwise(-1e9)
    high = F.when(F.col("target") > F.col("source_size"), F.log(F.lit(float(most))) * F.col("scale") / F.col("least")).otherwise(0.0)
    start = F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.log(F.col("target") / F.col("source_size"))).otherwise(F.col("low"))
    state = cut(state.withColumn("low", low).withColumn("high", high).withColumn("tilt", F.greatest("low", F.least("high", start)))
                .select("source", "source_size", "target", "scale", "low", "high", "tilt"))
    for _ in range(rounds):
        r = F.exp(F.col("tilt") * F.col("size") / F.col("scale"))
        words = F.col("n") * F.col("size") * F.least(r, F.lit(float(most)))
        slope = F.when(r < most, F.col("n") * F.col("size") * r * F.col("size") / F.col("scale")).otherwise(0.0)
        s = state.withColumnRenamed("source", "__s")
        sums = hist.join(s, hist["source"].eqNullSafe(F.col("__s"))).groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("source_size", "target", "scale", "low", "high", "tilt")], F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        above = F.col("words") > F.col("target")
        lo, hi = F.when(above, F.col("low")).otherwise(F.col("tilt")), F.when(above, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        good = (F.col("words") > 0) & (F.col("target") > 0) & (F.col("slope") > 0)
        gap = F.abs(F.col("words") - F.col("target")) / F.greatest("target", F.lit(1.0))
        sums = sums.withColumn("gap", gap).withColumn("newton", F.when(good, newton)).withColumn("lo", lo).withColumn("hi", hi)
        step = F.when(F.col("gap") <= tolerance, F.col("tilt")).when(F.col("newton").between(F.col("lo"), F.col("hi")), F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(sums.select("source", "source_size", "target", "scale", F.col("lo").alias("low"), F.col("hi").alias("high"), step.alias("tilt"),
                                ((F.col("gap") > tolerance) & (F.col("target") > 0) & (F.col("hi") - F.col("lo") > 1e-12 * F.abs(F.col("hi")))).alias("open")))
        if not state.where("open").limit(1).count():
            break
        state = state.drop("open")
    s = state.select(F.col("source").alias("__s"), "scale", "tilt", "target", "source_size")
    full = F.col("target") >= most * F.col("source_size")
    rate = F.when(F.col("target") <= 0, 0.0).when(full, float(most)).otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("scale")), F.lit(float(most))))
    return hist.join(s, hist["source"].eqNullSafe(F.col("__s"))).select("source", "size", "n", rate.alias("rate"))


def whole_copies(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies for the documents of each size of one source, longest first; what is owed passes on."""
    group = group.sort_values("size", ascending=False, kind="stable")
    owed, copies = 0.0, []
    for size, n, rate in zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist(), strict=True):
        owed += n * rate * size
        k = min(most * n, max(0, round(owed / size))) if size else round(n * rate)
        owed -= k * size
        copies.append(k)
    return group[["source", "size"]].assign(copies=np.array(copies, np.int64))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Targets as in ``targets`` (weights in turn by source name), rates as in ``balance``. All documents of one source
    and size have one rate, so whole copies are dealt out to these groups, longest first, and what rounding leaves
    over passes on to the next shorter size: the words of a source miss its target by about half its shortest
    document at most. Rounding sees one row per size, never the documents. Within a group the documents that get a
    copy more are those whose id hashes lowest, so that reruns agree.

    A null text is empty and has size 0; a null source is a source of its own, the last; documents of size 0 take
    no words. Rows that repeat a doc_id count one by one. An empty table gives no rows.
    """
    return _dealt(sizes(docs), cut(sizes(docs)), weights, most).drop("part", "at")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = MOST) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken, and ``__copy`` (from 1).

    Documents of size 0 hold no words of the mix and are not in it.
    """
    rows = sizes(docs.select(F.struct("*").alias("doc"), "text", "doc_id", "source"), "doc")
    taken = _dealt(rows, cut(sizes(docs)), weights, most).where("size > 0 and copies > 0")
    return taken.select("doc.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))


def _dealt(rows: DataFrame, counted: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """``rows`` (with doc_id, source, size) and what each is dealt; ``counted`` has the same documents without text."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    by_part = cut(counted.groupBy("source", "size", part.alias("part")).agg(F.count("*").alias("n")))
    hist = cut(by_part.groupBy("source", "size").agg(F.sum("n").alias("n")))
    goals = cut(targets(cut(cycle_weights(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights)), most))
    schema = hist.select("source", "size", F.col("n").alias("copies")).schema
    dealt = balance(hist, goals, most).groupBy("source").applyInPandas(lambda g: whole_copies(g, most), schema)
    plan = _shared(by_part, hist, dealt, goals)
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    own = rows.withColumn("part", part).withColumn("at", rank)
    hit = own.join(plan, [own["source"].eqNullSafe(plan["s"]), own["size"] == plan["z"], own["part"] == plan["p"]])
    copies = (F.col("base") + F.when(F.col("before") + F.col("at") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return hit.select(*own.columns, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _shared(by_part: DataFrame, hist: DataFrame, dealt: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source, size and part: copies that all documents get, how many of the group get one more, and
    how many documents of the group stand in earlier parts."""
    d = dealt.select(F.col("source").alias("s"), F.col("size").alias("z"), "copies")
    each = hist.join(d, [hist["source"].eqNullSafe(d["s"]), hist["size"] == d["z"]])
    each = each.select("s", "z", F.floor(F.col("copies") / F.col("n")).alias("base"), F.pmod(F.col("copies"), F.col("n")).alias("extra"))
    g = goals.select(F.col("source").alias("gs"), "source_size", "target")
    each = each.join(g, each["s"].eqNullSafe(g["gs"])).drop("gs")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = by_part.withColumn("before", before)
    return parts.join(each, [parts["source"].eqNullSafe(each["s"]), parts["size"] == each["z"]]).select("s", "z", F.col("part").alias("p"), "before", "base", "extra", "source_size", "target")


@query("op1_mix_sources")
def op1(spark: SparkSession, path: str) -> DataFrame:
    return mix(table(spark, path, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
