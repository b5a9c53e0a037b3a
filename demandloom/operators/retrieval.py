"""Lexical ranking, intents and recommended actions as batch jobs over tables of texts."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..session import materialize

# fixed values: words that tell what a question is about
FORECAST_WORDS = ("forecast", "predict", "next month", "next year", "confidence", "wape", "bias", "mae", "trust")
CHANGE_WORDS = ("why", "drop", "decline", "down", "rose", "rise", "increase", "anomaly", "alert", "abnormal", "change")
# end of fixed values


def intent(c) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.rlike("|".join(FORECAST_WORDS)), "forecast").when(t.rlike("|".join(CHANGE_WORDS)), "change").otherwise("overview")


#: Words of questions in a broadcast index (about 30 bytes each); more questions are dealt to cells with the snippets.
MOST_POSTINGS = 20_000
_WORD = re.compile("[a-z0-9_]+")
#: Longest snippets that are scored first, in one task, to bound what can win.
SEEDS = 128
#: Words of snippets that a cell indexes (about 30 bytes each).
CELL_WORDS = 32_000_000
#: Longest snippets that all questions meet first, and the part of a cell's words they may hold.
LONGEST, LONGEST_PART = 8192, 8
#: Focus terms in one automaton; further terms take further passes over the snippets.
MOST_TERMS = 200_000


class _Index:
    """Questions as arrays that travel to the tasks: postings of each word, and the words of each question from rare to frequent.

    A posting's ``slack`` is the number of words its question has from that word on, in that order. A snippet that shares k words
    with a question shares one whose slack is k or more, so postings of less slack can be skipped once k words are needed to win.
    """

    def __init__(self, rows: list, top_base: float):
        self.ids = [r.question_id for r in rows]
        words = sorted({w for r in rows for w in r.words})
        self.number = {w: i for i, w in enumerate(words)}
        at = np.array([self.number[w] for r in rows for w in r.words], np.int64)
        size = np.array([len(r.words) for r in rows], np.int64)
        owner = np.repeat(np.arange(len(rows)), size)
        order = np.lexsort((at, np.bincount(at, minlength=len(words))[at], owner))
        self.words_of, self.first = at[order], np.concatenate([[0], np.cumsum(size)])
        slack = self.first[owner + 1] - np.arange(len(at))
        by = np.argsort(self.words_of, kind="stable")
        self.word, self.owner, self.slack = self.words_of[by], owner[by], slack[by]
        self.most = int(size.max(initial=0))
        self.top = np.ceil(round(top_base * 100, 6)) / 100
        self.terms = sorted({r.focus for r in rows if r.focus})
        at_term = {t: i for i, t in enumerate(self.terms)}
        self.term_of = np.array([at_term.get(r.focus, -1) for r in rows], np.int64)

    def automaton(self):
        """All focus terms as one automaton: a text is read once, whatever their number."""
        found = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            found.add_word(t, i)
        if self.terms:
            found.make_automaton()
        return found

    def least(self, floor: np.ndarray) -> np.ndarray:
        """Words that a snippet must share with each question to beat its ``floor``, with the highest base and the focus term on its side."""
        gap = np.maximum(floor, -1e6) - self.top - 3.0 * (self.term_of >= 0)
        return np.maximum(1, np.floor(np.round(gap, 2) / 2) + 1)

    def postings(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owners by word, start of each word) of the postings that can still lead to a winner."""
        live = self.slack >= self.least(floor)[self.owner]
        return self.owner[live], np.searchsorted(self.word[live], np.arange(len(self.number) + 1))

    def shared(self, who: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Words of each question of ``who`` that are marked in ``has``."""
        size = self.first[who + 1] - self.first[who]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[who] - ends + size, size)
        total = np.concatenate([[0], np.cumsum(has[self.words_of[at]])])
        return total[ends] - total[ends - size]


def _streamed(index, floors, limit: int, kind, always: frozenset = frozenset(), scored: list | None = None):
    """A pass of snippets, which come in the order that settles ties, over an index of questions: each task keeps the best few of a
    question. ``floors`` holds scores that a winner must exceed; they rise with the last of the best few, and postings that lead to no
    winner any more are left out. ``always`` names snippets that may win without a shared word; ``scored``, in tests, takes the number of
    pairs scored for each snippet."""
    def search(batches):
        q: _Index = index.value
        terms, n = q.automaton(), len(q.ids)
        floor = np.array(floors.value, float)
        best, held, seen = np.full((n, limit), -np.inf), np.full((n, limit), -1, np.int64), []
        has = np.zeros(len(q.number), bool)
        for b in batches:
            owner, start = q.postings(floor)
            cols = {c: b.column(c).to_pylist() for c in ("snippet_id", "title", "priority", "base_score", "low")}
            eager = (q.term_of >= 0) & (np.round(floor - q.top, 2) < 3)                  # the focus term alone may win
            for i, base in enumerate(cols["base_score"]):
                low, free = cols["low"][i], cols["snippet_id"][i] in always
                known = np.array([q.number[w] for w in set(_WORD.findall(low)) if w in q.number], np.int64)
                if base + 2.0 * min(len(known), q.most) + 3.0 <= floor.min(initial=np.inf):
                    continue                                   # can beat no question's last
                lists = [owner[start[k]:start[k + 1]] for k in known[start[known + 1] > start[known]].tolist()]
                if free:
                    lists = [np.arange(n)]
                elif eager.any():
                    hit = np.zeros(len(q.terms) + 1, bool)
                    hit[[t for _, t in terms.iter(low)]] = True
                    lists.append(np.flatnonzero(eager & hit[q.term_of]))
                if not lists:
                    continue
                wins = np.unique(np.concatenate(lists))
                has[known] = True
                common = q.shared(wins, has)
                has[known] = False
                if scored is not None:
                    scored.append(len(wins))
                raw = 2.0 * common + base
                close = (raw + 3.0 > floor[wins] - 0.005) & (q.term_of[wins] >= 0)
                asked = q.term_of[wins]
                with_term = np.isin(asked, [t for t in np.unique(asked[close]).tolist() if q.terms[t] in low]) & close
                score = np.round(raw + 3.0 * with_term, 2)
                better = (score > floor[wins]) & (score > 0) & ((common > 0) | with_term | free)
                wins, score = wins[better], score[better]
                if not len(wins):
                    continue
                seen.append([cols[c][i] for c in ("snippet_id", "title", "priority")])
                # among equal lowest scores the one that came last leaves
                own = best[wins]
                j = np.where(own == own.min(1, keepdims=True), held[wins], -2).argmax(1)
                best[wins, j], held[wins, j] = score, len(seen) - 1
                floor[wins] = np.maximum(floor[wins], best[wins].min(1))
        k, j = np.nonzero(held >= 0)
        rows = held[k, j].tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array([q.ids[x] for x in k.tolist()], kind), pa.array([seen[r][0] for r in rows], pa.string()), pa.array([seen[r][1] for r in rows], pa.string()),
            pa.array([seen[r][2] for r in rows], pa.int32()), pa.array(best[k, j], pa.float64())], names=["question_id", "snippet_id", "title", "priority", "score"])
    return search


def _floors(index: _Index, found: list, limit: int) -> np.ndarray:
    """Scores that winners exceed, from (question_id, score) of ``limit`` or more different snippets: the worst of them, less one step."""
    out = np.full(len(index.ids), -np.inf)
    per: dict = {}
    for r in found:
        per.setdefault(r.question_id, []).append(r.score)
    for i, q in enumerate(index.ids):
        scores = sorted(per.get(q, []), reverse=True)
        if len(scores) >= limit:
            out[i] = scores[limit - 1] - 0.01
    return out


class _Postings:
    """Snippets of a cell, the longest first: for each key (a word, or '#' and the number of a focus term) the places of those that hold it."""

    def __init__(self, batches: list, seed: int):
        """batches: (id, base score, number of keys, keys as one dictionary array) of snippets, in the order that settles ties."""
        self.id, self.base, size = (np.concatenate([b[i] for b in batches]) for i in range(3))
        self.turn = np.argsort(-size, kind="stable")
        place = np.empty(len(size), np.int64)
        place[self.turn] = np.arange(len(size))
        self.id, self.base, self.top = self.id[self.turn], self.base[self.turn], self.base.max(initial=0.0)
        coded = pa.chunked_array([b[3] for b in batches]).unify_dictionaries()
        self.keys = coded.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
        batches.clear()
        code <<= 32
        code |= np.repeat(place, size)
        code.sort()
        at = np.arange(len(self.keys) + 1) << 32
        self.start, self.head = np.searchsorted(code, at), np.searchsorted(code, at + seed) if seed else None
        code &= 0xFFFFFFFF
        self.place, self.mark = code.astype(np.int32), np.zeros(len(size), bool)

    def holds(self, lo: int, hi: int, at: np.ndarray) -> np.ndarray:
        """Which of ``at`` are among the places lo to hi."""
        rows = self.place[lo:hi]
        if len(at) * 6 < len(rows):
            return rows[np.minimum(np.searchsorted(rows, at), len(rows) - 1)] == at
        self.mark[rows] = True
        hit = self.mark[at]
        self.mark[rows] = False
        return hit

    def met(self, starts: list, ends: list, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, points) of the snippets that hold a key: 2 for a word, 3 for the focus term, which is number ``term`` of the keys."""
        x = np.concatenate([self.place[a:b] for a, b in zip(starts, ends, strict=True)])
        x.sort()
        cut = np.flatnonzero(x[1:] != x[:-1]) + 1
        at = x[np.concatenate([[0], cut])] if len(x) else x
        points = 2 * np.diff(np.concatenate([[0], cut, [len(x)]])) if len(x) else np.zeros(0, np.int64)
        if 0 <= term < len(starts) and ends[term] > starts[term]:
            points += self.holds(starts[term], ends[term], at)
        return at, points

    def scores(self, at: np.ndarray, points: np.ndarray) -> np.ndarray:
        term = points & 1
        return np.round(points - 3.0 * term + self.base[at] + 3.0 * term, 2)

    def best(self, starts: list, ends: list, heads: list | None, term: int, floor: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best ``limit`` snippets of a question that score ``floor`` or more.

        The keys of the question come from rare to frequent. Only the rare ones bring in snippets: one that is first met when the keys left
        are worth too little can't reach the floor any more. Each further key then leaves out more of those met. ``heads`` ends the
        longest snippets of each key; they are scored first where that may raise the floor.
        """
        if heads:
            at, points = self.met(starts, heads, term)
            if len(at) >= limit:
                floor = max(floor, np.partition(self.scores(at, points), -limit)[-limit])
        need, left, k = floor - self.top - 0.006, 2 * len(starts) + (term >= 0), 0
        while k < len(starts) and left >= need:
            left, k = left - 2 - (k == term), k + 1
        if not k:
            return np.zeros(0, np.int32), np.zeros(0)
        room = 4 * (sum(ends[:k]) - sum(starts[:k]))                                          # a few more keys at once, as counting is cheaper than looking up
        while k < len(starts) and room >= ends[k] - starts[k]:
            room, left, k = room - ends[k] + starts[k], left - 2 - (k == term), k + 1
        at, points = self.met(starts[:k], ends[:k], term)
        for k in range(k, len(starts)):
            alive = points >= need - left
            at, points = at[alive], points[alive]
            if not len(at):
                break
            worth = 2 + (k == term)
            points, left = points + worth * self.holds(starts[k], ends[k], at), left - worth
        score = self.scores(at, points)
        good = np.flatnonzero((score >= floor) & (score > 0))
        if len(good) > 50 * limit:
            good = good[score[good] >= np.partition(score[good], -limit)[-limit]]
        if len(good) > limit:
            good = good[np.lexsort((self.turn[at[good]], -score[good]))[:limit]]
        return at[good], score[good]


def _met(limit: int, seed: int):
    """A pass over the rows of a cell, first its snippets, then its questions: (question, snippet, score) of each question's best few.
    ``seed`` of the cell's longest snippets are scored first."""
    def answers(index: _Postings, asked: pa.RecordBatch):
        keys = pc.split_pattern(asked.column("keys"), " ")
        flat, size = keys.flatten(), pc.list_value_length(keys).to_numpy()
        code = pc.index_in(flat, value_set=index.keys)
        known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        code, term = code.fill_null(0).to_numpy()[known], pc.starts_with(flat, "#").to_numpy(zero_copy_only=False)[known]
        owner, often = np.repeat(np.arange(len(size)), size)[known], index.start[code + 1] - index.start[code]
        order = np.lexsort((often, owner))
        code, term, cuts = code[order], term[order], np.searchsorted(owner, np.arange(len(size) + 1)).tolist()
        starts, ends, heads = index.start[code].tolist(), index.start[code + 1].tolist(), index.head[code].tolist() if seed else None
        terms = dict(zip(owner[order][term].tolist(), np.flatnonzero(term).tolist(), strict=True))
        floors, who, what, score = asked.column("bound").to_pylist(), [], [], []
        for i, floor in enumerate(floors):
            lo, hi = cuts[i], cuts[i + 1]
            at, s = index.best(starts[lo:hi], ends[lo:hi], heads[lo:hi] if seed else None, terms.get(i, lo - 1) - lo, floor, limit)
            if len(at):
                who.append(np.full(len(at), i))
                what.append(at)
                score.append(s)
        if who:
            yield pa.RecordBatch.from_arrays([pa.array(asked.column("id").to_numpy()[np.concatenate(who)]), pa.array(index.id[np.concatenate(what)]), pa.array(np.concatenate(score))],
                                             names=["q", "sid", "score"])

    def run(batches):
        index, of, held = None, None, []
        for b in batches:
            cell, asks = b.column("cell").to_numpy(), b.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cell)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if of != cell[lo]:
                    index, of, held = None, cell[lo], []
                if not asks[lo]:
                    keys = pc.split_pattern(part.column("keys"), " ")
                    held.append((part.column("id").to_numpy(), part.column("bound").to_numpy(), pc.list_value_length(keys).to_numpy(), keys.flatten().dictionary_encode()))
                    continue
                if held:
                    index = _Postings(held, seed)
                if index is not None:
                    yield from answers(index, part)
    return run


def _through_cells(asked: DataFrame, snippets: DataFrame, limit: int, cell: int, seed: int) -> DataFrame:
    """(q, sid, score): questions (q, keys, floor) meet snippets (sid, priority, title, snippet_id, base_score, n, keys) in a grid of cells.

    A cell has snippets of about ``cell`` words and a part of the questions; as many parts as keep all cores at work.
    """
    words = snippets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-words // cell))
    parts = max(1, -(-snippets.sparkSession.sparkContext.defaultParallelism // blocks))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")                              # noqa: E731
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))                                 # noqa: E731
    s = snippets.withColumn("block", deal("sid", blocks)).withColumn("part", each(parts)).select(
        (F.col("block") * parts + F.col("part")).alias("cell"), F.lit(0).alias("asks"), "priority", "title", "snippet_id", F.col("sid").alias("id"), F.col("base_score").alias("bound"), "keys")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)                                 # noqa: E731
    q = asked.withColumn("part", deal("q", parts)).withColumn("block", each(blocks)).select(
        (F.col("block") * parts + F.col("part")).alias("cell"), F.lit(1).alias("asks"), none("int", "priority"), none("string", "title"), none("string", "snippet_id"),
        F.col("q").alias("id"), F.col("floor").alias("bound"), "keys")
    rows = s.unionByName(q).repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "asks", "priority", "title", "snippet_id")
    return rows.select("cell", "asks", "id", "bound", "keys").mapInArrow(_met(limit, seed), "q long, sid long, score double")


def _with_terms(snippets: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds to ``keys`` '#' and the number of each focus term (term, number) that occurs in ``low``."""
    n = terms.count()
    for i in range(passes := -(-n // MOST_TERMS)):
        rows = terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).collect()
        sent = snippets.sparkSession.sparkContext.broadcast([(r.term, f"#{r.number}") for r in rows])

        def find(batches, sent=sent):
            found = ahocorasick.Automaton()
            for t, key in sent.value:
                found.add_word(t, key)
            found.make_automaton()
            few = len(sent.value) < 16
            for b in batches:
                keys = [" ".join([*([k] if k else []), *([key for t, key in sent.value if t in low] if few else sorted({key for _, key in found.iter(low)}))])
                        for low, k in zip(b.column("low").to_pylist(), b.column("keys").to_pylist(), strict=True)]
                yield b.set_column(b.schema.get_field_index("keys"), "keys", pa.array(keys, pa.string()))
        snippets = snippets.mapInArrow(find, snippets.schema)
    return snippets


def _in_cells(questions: DataFrame, s: DataFrame, limit: int, cell: int) -> DataFrame:
    """candidates() for many questions: no index of all questions or all snippets anywhere.

    Questions and snippets meet in a grid of cells, in two rounds. First come the longest snippets, which share most words; the last of
    the best few is then the floor of the question, and all other snippets need only be looked for among those that hold its rarer words.
    """
    terms = materialize(questions.select(F.col("focus").alias("term")).filter("term <> ''").distinct().withColumn("number", F.monotonically_increasing_id()))
    s = s.filter("base_score IS NOT NULL").select("snippet_id", "title", "priority", "base_score", "low", F.array_join(T.tokens(F.col("low")), " ").alias("keys"))
    s = _with_terms(s, terms).drop("low").withColumn("n", F.when(F.col("keys") == "", 0).otherwise(F.length("keys") - F.length(F.replace("keys", F.lit(" "), F.lit(""))) + 1).cast("long"))
    s = materialize(s.withColumn("sid", F.monotonically_increasing_id()))
    asked = questions.join(terms, questions.focus == terms.term, "left").select(
        "question_id", F.array_join(F.concat("words", F.when(F.col("number").isNotNull(), F.array(F.concat(F.lit("#"), F.col("number").cast("string")))).otherwise(F.array().cast("array<string>"))), " ").alias("keys"))
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()))
    alone = s.select("sid", (F.rint(F.col("base_score") * 100) / 100).alias("score"), "priority", "title", "snippet_id").filter("score > 0")
    always = alone.orderBy(F.desc("score"), "priority", "title", "snippet_id").limit(limit).select("sid", "score").collect()      # they win without a shared word
    least = always[-1].score if len(always) == limit else float("-inf")
    whole, filled = s.filter("n > 0"), asked.filter("keys <> ''").select("q", "keys")
    longest, room = [], max(1, cell // LONGEST_PART)
    for r in whole.select("n", "sid").orderBy(F.desc("n"), "sid").limit(LONGEST).collect():
        room -= r.n
        if longest and room < 0:
            break
        longest = [r.n, r.sid]
    out = asked.select("q").crossJoin(F.broadcast(s.sparkSession.createDataFrame(always, "sid long, score double")))
    if longest:
        early = F.coalesce((F.col("n") > longest[0]) | ((F.col("n") == longest[0]) & (F.col("sid") <= longest[1])), F.lit(False))
        first = materialize(_through_cells(filled.withColumn("floor", F.lit(least)), whole.filter(early), limit, cell, 512))
        last = first.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("k") == limit).select("q", F.col("score").alias("floor"))
        out = out.unionByName(first)
        rest = whole.filter(~early)
        if not rest.isEmpty():
            out = out.unionByName(_through_cells(filled.join(last, "q", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(least)), F.lit(least))), rest, limit, cell, 0))
    out = out.groupBy("q", "sid").agg(F.max("score").alias("score"))                       # one that always counts may share words as well
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    out = out.withColumn("k", F.rank().over(best)).filter(F.col("k") <= limit).drop("k")
    return (out.join(s.select("sid", "snippet_id", "title", "priority"), "sid").join(asked.select("q", "question_id"), "q")
            .select("question_id", "snippet_id", "title", "priority", "score"))


def candidates(questions: DataFrame, snippets: DataFrame, limit: int = 6, most: int = MOST_POSTINGS, cell: int = CELL_WORDS) -> DataFrame:
    """(question_id, snippet_id, title, priority, score): at most ``limit`` rows of each task and question, the winners among them.

    Questions of at most ``most`` words in all are indexed; the snippets, each distinct one once and dealt over all tasks, are streamed
    through the index. The longest ``SEEDS`` snippets go first: what they score bounds each question's last winner from below, so
    that a pair is scored only if it shares one of the question's rarer words, and leaves a task only if it may be a winner.
    More questions meet the snippets in cells, each with an index of snippets of about ``cell`` words.
    """
    spark = snippets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = snippets.withColumn("h", F.xxhash64("content", F.sha2("content", 256))).repartition(n, "source", "title", "h")
    first = Window.partitionBy("source", "title", "h").orderBy("snippet_id")
    low = F.lower(F.concat_ws(" ", "title", "content", F.array_join("tags", " ")))
    s = s.withColumn("k", F.row_number().over(first)).filter("k = 1").select(
        "snippet_id", "title", F.col("priority").cast("int").alias("priority"), F.col("base_score").cast("double").alias("base_score"), low.alias("low"))
    asked = materialize(questions.select("question_id", T.tokens(F.col("text")).alias("words"), F.lower(F.coalesce("focus", F.lit(""))).alias("focus")))
    kind = questions.schema["question_id"].dataType
    out = spark.createDataFrame([], f"question_id {kind.simpleString()}, snippet_id string, title string, priority int, score double")
    words, n = asked.agg(F.sum(F.size("words")), F.count(F.lit(1))).first()
    if not n:
        return out
    if words > most or n > most:
        return _in_cells(asked, s, limit, cell)
    s = materialize(s.sortWithinPartitions("priority", "title", "snippet_id"))               # read for the seeds and for the index
    always = (s.select("snippet_id", "title", "priority", "base_score").filter("base_score > 0")              # ``limit`` rows: they win without a shared word
              .orderBy(F.desc("base_score"), "priority", "title", "snippet_id").limit(limit).collect())
    free = frozenset(r.snippet_id for r in always)
    seeds = materialize(s.orderBy(F.length("low").desc(), "snippet_id").limit(SEEDS).coalesce(1))
    index = _Index(asked.collect(), max((r.base_score for r in always), default=0.0))            # at most ``most`` words
    sent, none = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(np.full(len(index.ids), -np.inf))
    found = seeds.mapInArrow(_streamed(sent, none, limit, to_arrow_type(kind), free), out.schema).select("question_id", "score").collect()      # ``limit`` rows a question
    floors = spark.sparkContext.broadcast(_floors(index, found, limit))
    return s.mapInArrow(_streamed(sent, floors, limit, to_arrow_type(kind), free), out.schema)


def rank_context(questions: DataFrame, snippets: DataFrame, limit: int = 6, most: int = MOST_POSTINGS, cell: int = CELL_WORDS) -> DataFrame:
    """Score = base + 2 per shared word (+3 when the focus term occurs); best few per question.

    questions: (question_id, text, focus); snippets: (snippet_id, source, title, content, tags, base_score, priority).
    Snippets equal in source, title and content count once, by their smallest id. Snippets without a shared word still count
    through their base score. Ties go by priority, title, id.
    """
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "priority", "title", "snippet_id")
    return (candidates(questions, snippets, limit, most, cell).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
            .select("question_id", "snippet_id", "score", "position"))


def recent_memories(memories: DataFrame, latest: int = 12) -> DataFrame:
    """Latest entries per scope."""
    w = Window.partitionBy("scope").orderBy(F.desc("created"), F.desc("memory_id"))
    return memories.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= latest)


def memory_matches(questions: DataFrame, memories: DataFrame, latest: int = 12, top: int = 3) -> DataFrame:
    """The first few recent memories of a question's scope that share a word (+2 for the same focus)."""
    m = recent_memories(memories, latest).withColumn("mt", T.tokens(F.col("text")))
    q = questions.withColumn("qt", T.tokens(F.col("text"))).select("question_id", "scope", "qt", F.col("focus").alias("qf"))
    j = q.join(m, "scope").withColumn("overlap", F.size(F.array_intersect("qt", "mt")) + F.when((F.coalesce("qf", F.lit("")) != "") & (F.col("focus") == F.col("qf")), 2).otherwise(0))
    w = Window.partitionBy("question_id").orderBy("k")
    return (j.filter("overlap > 0").withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)
            .select("question_id", "memory_id", "overlap", (F.col("overlap") + 1.0).alias("base_score"), "position"))


def focus_part(questions: DataFrame, parts: DataFrame, top_alert: str | None = None) -> DataFrame:
    """Explicit focus, else a part number that stands as a word in the text, else the top alert."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), 1))
    q = questions.select("question_id", F.explode(words).alias("w"))
    p = parts.select(F.lower("part_number").alias("w"), "part_number").distinct()
    hit = q.join(p, "w").groupBy("question_id").agg(F.min("part_number").alias("hit"))
    return questions.join(hit, "question_id", "left").select(
        "question_id", F.coalesce(F.nullif(F.col("focus"), F.lit("")), F.col("hit"), F.lit(top_alert or "")).alias("part_number"))


def analyst_risk(risk: Column, confidence: Column, wape: Column, regime: Column) -> Column:
    """High / Medium / Low from forecast risk, confidence, error and shape."""
    w = lambda x: F.coalesce(wape >= x, F.lit(False))
    return (F.when((risk == "High") | (confidence == "Low") | w(0.55), "High").when((risk == "Medium") | (confidence == "Medium") | w(0.3), "Medium")
            .when(regime.isin("structural_drop", "structural_ramp"), "High").when(regime.isin("declining", "accelerating", "volatile"), "Medium").otherwise("Low"))


def actions(regime: Column, risk: Column, bias: Column, strength: Column, driver: Column) -> Column:
    """Up to four action codes."""
    rows = F.filter(F.array(
        F.lit("review_latest_change"), F.when(driver.isNotNull(), F.concat(F.lit("check_driver:"), driver)), F.when(strength == "Weak", "do_not_rely_on_exposure"),
        F.when(regime == "structural_drop", "avoid_old_volume").when(regime == "structural_ramp", "check_program_ramp"),
        F.when(risk == "High", "use_as_high_risk_baseline").when(risk == "Medium", "compare_recent_average"),
        F.when(bias <= -0.25, "under_forecast_review").when(bias >= 0.25, "over_forecast_review")), lambda x: x.isNotNull())
    return F.slice(rows, 1, 4)


def document_snippets(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Whole paragraphs as snippets: all of them, or the first ``most`` of each document."""
    chunks = T.paragraphs(F.col("text"))
    e = docs.select("doc_id", "source", F.posexplode(F.slice(chunks, 1, most) if most else chunks).alias("i", "content"))
    return e.select(F.concat_ws("-", "doc_id", "i").alias("snippet_id"), F.lit("knowledge_doc").alias("source"),
                    F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" section "), (F.col("i") + 1).cast("string")).alias("title"), "content",
                    F.array(F.col("source"), F.lit("knowledge")).alias("tags"), F.lit(0.6).alias("base_score"), F.lit(6).alias("priority"))


def result_snippets(profile: DataFrame, alerts: DataFrame, scope_rows: DataFrame) -> DataFrame:
    """Scope, field and alert rows of a context table."""
    arr = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    sc = scope_rows.select(F.lit("scope").alias("snippet_id"), F.lit("data_scope").alias("source"), F.lit("scope").alias("title"),
                           F.concat(F.lit("rows: "), F.col("row_count").cast("string")).alias("content"), arr("filters", "scope", "slice").alias("tags"), F.lit(2.0).alias("base_score"), F.lit(1).alias("priority"))
    fl = profile.select(F.concat(F.lit("field-"), "column").alias("snippet_id"), F.lit("field_profile").alias("source"), F.concat(F.lit("field:"), "column").alias("title"),
                        F.concat_ws("; ", "type", F.concat(F.lit("missing "), F.col("missing_pct").cast("string")), F.concat(F.lit("unique "), F.col("distinct").cast("string")), "samples").alias("content"),
                        arr(F.col("column"), "schema", "field").alias("tags"), F.lit(1.5).alias("base_score"), F.lit(2).alias("priority"))
    al = alerts.orderBy(F.desc("alert_score"), "part_number").limit(4).withColumn("k", F.row_number().over(Window.orderBy(F.desc("alert_score"), "part_number"))).select(
        F.concat(F.lit("alert-"), "part_number").alias("snippet_id"), F.lit("anomaly_center").alias("source"), F.concat(F.lit("alert:"), "part_number").alias("title"),
        "evidence", arr("anomaly", "change", F.col("part_number")).alias("tags"), F.when(F.col("k") == 1, 2.5).otherwise(1.4).alias("base_score"), F.lit(3).alias("priority")).withColumnRenamed("evidence", "content")
    return sc.unionByName(fl).unionByName(al)
