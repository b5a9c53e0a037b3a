"""Byte-pair encoding of whole texts by tree concatenation, and decoding."""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table
from .registry import query

#: A text of more code points is halved until its pieces have at most so many; each piece is a row of its own.
LEAF = 8192
#: Code points of the first window on either side of a join.
WINDOW = 16
#: Words whose tokens a worker remembers, and the longest word that it does.
MOST_KNOWN, LONGEST_KNOWN = 400_000, 200


def flat(text: str) -> str:
    """Text whose common white space is spaces: each ends a token, whatever stands around it."""
    return text.replace("\t", " ").replace("\n", " ").replace("\r", " ")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: Marks that are never joined with a letter or digit before them.
_CLOSING = ".,;:!?)\""
_ANY = itemgetter(0)
#: Below it, normalization and lower case of a letter do not depend on its neighbours.
_LATIN = "\u0250"


class _Known(dict):
    """Words that were met, with their ids and decoded text."""

    def __init__(self, own: Coder):
        super().__init__()
        self.own = own

    def __missing__(self, w: str) -> tuple[bytes, bytes]:
        out = self.own.word(w)
        if len(w) <= LONGEST_KNOWN:
            self[w] = out
        return out


@dataclass
class Run:
    """Tokens of a stretch of text: ids and the code points [start, end) that each covers."""
    text: str
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def packed(self) -> bytes:
        return np.stack([self.ids, self.start, self.end]).astype("<i4").tobytes()

    @staticmethod
    def of(text: str, packed: bytes) -> Run:
        a = np.frombuffer(packed, "<i4").reshape(3, -1)
        return Run(text, a[0], a[1], a[2])

    def groups(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Token ranges that cover whole code points, by their extent: tokens that share a code point are one group."""
        out, first = {}, 0
        for i in range(1, len(self.ids) + 1):
            if i == len(self.ids) or self.start[i] >= self.end[first:i].max():
                out[int(self.start[first]), int(self.end[first:i].max())] = (first, i)
                first = i
        return out


@dataclass
class Node:
    """Tokens of a piece: a run before its first white space, settled ids, and a run from its last white space on.

    A piece without white space is one run: it is ``head``, and ``tail`` is None.
    """
    head: Run
    middle: list[bytes] = field(default_factory=list)
    tail: Run | None = None

    def ids(self) -> list[bytes]:
        return [self.head.ids.astype("<u4").tobytes(), *self.middle, *([self.tail.ids.astype("<u4").tobytes()] if self.tail else [])]


class Coder:
    """A tokenizer file with a memory for words; the same input always gives the same tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"          # the parallelism is Spark's
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.names = [(self.tok.id_to_token(i) or "").encode() for i in range(self.tok.get_vocab_size())]
        self.known = _Known(self)
        # a letter's bytes as the vocabulary spells them; used only if words made of them give what the whole tokenizer gives
        letters = [c for c in map(chr, range(ord(_LATIN))) if c.isalpha() and c != "\u0130"]
        self.letters = {ord(c): "".join(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(c.lower())) for c in letters}
        probes = ["".join(letters[i::7]) for i in range(7)] + letters
        self.plain = all(self.tok.encode(p, add_special_tokens=False).ids == [t.id for t in self.tok.model.tokenize(p.translate(self.letters))] for p in probes)

    def run(self, text: str) -> Run:
        e = self.tok.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int32).reshape(-1, 2)
        return Run(text, np.array(e.ids, np.int32), at[:, 0], at[:, 1])

    def _words(self, text: str) -> list[tuple[bytes, bytes]]:
        """The ids of each word and their decoded text, a word being what stands between white space."""
        if len(self.known) > MOST_KNOWN:
            self.known = _Known(self)
        return list(filter(_ANY, map(self.known.__getitem__, flat(text).split(" "))))

    def word(self, w: str) -> tuple[bytes, bytes]:
        """ids of a word without white space, and their decoded text."""
        core = w.rstrip(_CLOSING)
        if core != w and core and core[-1].isascii() and core[-1].isalnum():          # closing marks are split off in any case
            pair = [x for x in (self.known[core], self.known[w[len(core):]]) if x[0]]
            return b"".join(x[0] for x in pair), b" ".join(x[1] for x in pair)
        if self.plain and w.isalpha() and max(w) < _LATIN and "\u0130" not in w:       # one piece, normalized letter by letter
            ids = [t.id for t in self.tok.model.tokenize(w.translate(self.letters))]
        else:
            ids = self.tok.encode(w, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        return raw, self.decode(raw)

    def encode(self, text: str) -> bytes:
        """ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([w[0] for w in self._words(text)])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, hash of the ids, hash of the decoded text."""
        words = self._words(text)
        raw = b"".join([w[0] for w in words])
        return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(b" ".join([w[1] for w in words])).hexdigest()

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8, special tokens included: this kind of vocabulary has no decoder, its tokens are joined by spaces."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def cuts(self, text: str, leaf: int) -> list[int]:
        """Borders of the halves of halves, none inside a special token's string."""
        out = [0, len(text)]
        while max(b - a for a, b in zip(out, out[1:], strict=False)) > leaf:
            out = [x for a, b in zip(out, out[1:], strict=False) for x in ((a, (a + b) // 2) if b - a > leaf else (a,))] + [len(text)]
        for s in self.special:
            for i, c in enumerate(out):
                at = text.find(s, max(c - len(s) + 1, 0), c + len(s) - 1)
                if at >= 0 and at < c:
                    out[i] = at + len(s)
        return sorted(set(out))

    def leaf(self, text: str) -> Node:
        """Tokens of a piece on its own."""
        plain = flat(text)
        i, j = plain.find(" "), plain.rfind(" ")
        if i < 0:
            return Node(self.run(text))
        return Node(self.run(text[:i]), [self.encode(text[i:j])], self.run(text[j:]))

    def join(self, left: Node, right: Node) -> Node:
        """Tokens of two neighbouring pieces together."""
        seam = self.joined(left.tail or left.head, right.head)
        if left.tail is None and right.tail is None:
            return Node(seam)
        if left.tail is None:
            return Node(seam, right.middle, right.tail)
        if right.tail is None:
            return Node(left.head, left.middle, seam)
        return Node(left.head, [*left.middle, seam.ids.astype("<u4").tobytes(), *right.middle], right.tail)

    def joined(self, a: Run, b: Run, window: int = WINDOW) -> Run:
        """Tokens of a.text + b.text from a's and b's: a window around the join is encoded again, and grows until it has a token
        group in common with either side, or reaches that side's end.

        A common group fixes what lies beyond it. Encoding merges neighbours by rank, so a sequence of tokens is the encoding of
        its text when every two neighbours are; the neighbours outside the window come from a or b, those inside from the window.
        The group must have a letter (or a mark, or a digit, as ``_firm`` has it) inside and outside its borders, so that the same
        split of words holds on both sides.
        """
        if not a.text or not b.text:
            return a if a.text else b
        text, border, mine, theirs = a.text + b.text, len(a.text), a.groups(), b.groups()
        while True:
            lo = max((s for s, _ in mine if s <= border - window), default=0)
            hi = min((e + border for _, e in theirs if e >= window), default=len(text))
            w = self.run(text[lo:hi])
            w.start, w.end = w.start + lo, w.end + lo
            fresh = w.groups()
            first = self._common(text, w, fresh, a, mine, 0, border, False) if lo > 0 else (0, 0)
            last = self._common(text, w, fresh, b, theirs, border, len(text), True) if hi < len(text) else (len(w.ids), len(b.ids))
            if first and last and first[0] <= last[0]:
                whole = [np.concatenate([x[:first[1]], y[first[0]:last[0]], z[last[1]:] + d]) for x, y, z, d in (
                    (a.ids, w.ids, b.ids, 0), (a.start, w.start, b.start, border), (a.end, w.end, b.end, border))]
                return Run(text, *whole)
            window *= 2

    @staticmethod
    def _common(text: str, w: Run, fresh: dict, side: Run, groups: dict, lo: int, hi: int, right: bool) -> tuple[int, int] | None:
        """Where to pass between the window and a side: (token of w, token of side), at the group next to the window's end."""
        shift = lo if right else 0
        for s, e in (reversed(list(fresh)) if right else fresh):
            other = groups.get((s - shift, e - shift))
            i, j = fresh[s, e]
            if s >= lo and e <= hi and other and np.array_equal(w.ids[i:j], side.ids[other[0]:other[1]]) and _firm(text, s) and _firm(text, e):
                return (j, other[1]) if right else (i, other[0])
        return None


def _kind(c: str) -> str:
    if c.isascii() and c.isdigit():
        return "digit"
    k = unicodedata.category(c)[0]
    return "letter" if k == "L" else "" if k in "NZC" or c.isspace() or c == "'" else "mark"


def _firm(text: str, at: int) -> bool:
    """Whether what stands around this place is split and normalized alike in any larger text: a digit is always by itself, two
    letters or two marks (apostrophes aside, which may begin a contraction) always stay together, and nothing composes across."""
    if at <= 0 or at >= len(text):
        return False
    x, y = text[at - 1], text[at]
    if unicodedata.combining(y) or unicodedata.normalize("NFC", x + y) != unicodedata.normalize("NFC", x) + unicodedata.normalize("NFC", y):
        return False
    a, b = _kind(x), _kind(y)
    return "digit" in (a, b) or (a == b and a != "")


@cache
def coder(path: str) -> Coder:
    """One for a worker, kept between tasks."""
    return Coder(path)


_RESULT = ["n_tokens", "ids_sha256", "decoded_sha256"]


def digests(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``: its whole text encoded, and decoded again.

    A text of up to ``leaf`` code points is encoded where it is. A longer one is halved, wherever that falls, until its pieces
    have no more; the pieces are dealt over all tasks and encoded side by side, and come together by text in their order, where
    neighbours are joined as a tree. Its ids are hashed as they stand, so a task holds the ids of one text, not its windows.

    A null or empty text has no tokens and the hash of nothing. Rows that repeat a document are each returned, a null doc_id
    too. An empty table gives no rows. Extra columns are not read.
    """
    path = path or vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    brief = docs.where(F.length("text") <= leaf).mapInArrow(_short(path), schema)
    rows = docs.where(F.length("text") > leaf).withColumn("row", F.struct("doc_id", F.monotonically_increasing_id().alias("n"), F.xxhash64("text").alias("h")))
    pieces = rows.select("row", "text").mapInArrow(_pieces(path, leaf), "row struct<doc_id:" + kind + ",n:bigint,h:bigint>, part int, text string")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    nodes = pieces.repartition(tasks, "row", "part").mapInArrow(_leaves(path), (
        "row struct<doc_id:" + kind + ",n:bigint,h:bigint>, part int, head string, head_ids binary, middle binary, tail string, tail_ids binary"))
    whole = nodes.repartition(tasks, "row").sortWithinPartitions("row", "part").mapInArrow(_trees(path, to_arrow_type(docs.schema["doc_id"].dataType)), schema)
    return brief.union(whole)


def _short(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            out = [own.digests(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(out)], names=["doc_id", *_RESULT])
    return encode


def _columns(out: list[tuple[int, str, str]]) -> list[pa.Array]:
    return [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]


def _pieces(path: str, leaf: int):
    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                at = own.cuts(text, leaf)
                parts = [text[x:y] for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array([i] * len(parts), pa.int64())), pa.array(range(len(parts)), pa.int32()),
                                                  pa.array(parts, pa.string())], names=["row", "part", "text"])
    return halve


def _leaves(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            nodes = [own.leaf(t) for t in b.column("text").to_pylist()]
            cols = [(n.head.text, n.head.packed(), b"".join(n.middle), n.tail and n.tail.text, n.tail and n.tail.packed()) for n in nodes]
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), *[pa.array([c[i] for c in cols], t) for i, t in enumerate(kinds)]],
                                             names=["row", "part", "head", "head_ids", "middle", "tail", "tail_ids"])
    return encode


def _trees(path: str, kind: pa.DataType):
    def concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        now, tree, out = None, [], []                 # tree: (number of pieces, node), each with more pieces than the next

        def close():
            node = tree.pop()[1]
            while tree:
                node = own.join(tree.pop()[1], node)
            ids, spelled, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
            for part in node.ids():
                if part:
                    ids.update(part)
                    spelled.update((b"" if first else b" ") + own.decode(part))
                    n, first = n + len(part) // 4, False
            out.append((now["doc_id"], n, ids.hexdigest(), spelled.hexdigest()))
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("row", "head", "head_ids", "middle", "tail", "tail_ids")}
            for row, head, head_ids, middle, tail, tail_ids in zip(*cols.values(), strict=True):
                if row != now:
                    if tree:
                        close()
                    now = row
                size, node = 1, Node(Run.of(head, head_ids), [middle], None if tail is None else Run.of(tail, tail_ids))
                while tree and tree[-1][0] == size:
                    size, node = 2 * size, own.join(tree.pop()[1], node)
                tree.append((size, node))
        if tree:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), *_columns([o[1:] for o in out])], names=["doc_id", *_RESULT])
    return concatenate


@query("op12_tree_bpe")
def op12(spark: SparkSession, path: str) -> DataFrame:
    return digests(table(spark, path, "documents"))
