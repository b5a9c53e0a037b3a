"""Chat formatting with loss masks aligned by offsets."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .registry import query

#: A vocabulary file of the ``tokenizers`` library, read by the driver and sent to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of conversations that a worker encodes or reads back at a time; a longer conversation goes by itself.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Template:
    """Marks of a turn. All begin with ``<|``, and no escaped text has ``<|``, so that nothing in a text is a mark.

    Escaping puts one backslash more between ``<`` and ``|`` (after those already there); reading takes it out again.
    """
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"

    @staticmethod
    def escape(s: str) -> str:
        return re.sub(r"<(\\*)\|", r"<\\\1|", s)

    @staticmethod
    def unescape(s: str) -> str:
        return re.sub(r"<\\(\\*)\|", r"<\1|", s)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The whole conversation, and where each turn's text stands in it."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.turn}{self.escape(role)}{self.text}", self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(out), spans

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        marks = map(re.escape, (self.turn, self.text, self.end))
        found = re.findall("{}(.*?){}(.*?){}".format(*marks), formatted, re.S)
        return [(self.unescape(r), self.unescape(t)) for r, t in found]


def under(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(mask, runs): which tokens lie in one of the sorted spans, found by binary search in the sorted offsets, and the
    runs of code points that the masked tokens of each span cover."""
    mask, runs = np.zeros(len(offsets), bool), []
    if not len(offsets):
        return mask, runs
    for s, e in spans:
        a, b = np.searchsorted(offsets[:, 0], s, "left"), np.searchsorted(offsets[:, 1], e, "right")
        if a < b:
            mask[a:b] = True
            runs.append((int(offsets[a, 0]), int(offsets[b - 1, 1])))
    return mask, runs


_OUT = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("loss", T.ArrayType(T.BooleanType())),
                     T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def pieces(most: int, *columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Runs of rows with at most ``most`` bytes in all columns, in order; one row at least."""
    sizes = [sum(c.slice(i, 1).nbytes for c in columns) for i in range(len(columns[0]))]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield tuple(c.slice(start, i - start) for c in columns)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield tuple(c.slice(start) for c in columns)


def encodings(batches: Iterator[pa.Array], tok, template: Template, learn: tuple[str, ...], most: int) -> Iterator[pa.Array]:
    """Structs of _OUT for arrays of turns, ``most`` bytes of conversations at a time: an encoding is many times the size of its text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for (batch,) in (p for b in batches for p in pieces(most, b)):
        talks = [[(t["role"], t["text"]) for t in x] for x in batch.to_pylist()]
        made = [template.render(t) for t in talks]
        found = tok.encode_batch([m[0] for m in made], add_special_tokens=False)
        masks = [under([s for s, (role, _) in zip(m[1], t, strict=True) if role in learn], np.array(e.offsets, np.int64).reshape(-1, 2))
                 for t, m, e in zip(talks, made, found, strict=True)]
        yield pa.StructArray.from_arrays([
            pa.array([m[0] for m in made], pa.string()), pa.array([e.ids for e in found], pa.list_(pa.int32())), pa.array([m.tolist() for m, _ in masks], pa.list_(pa.bool_())),
            pa.array([[{"start": a, "end": b} for a, b in r] for _, r in masks], kind)], names=_OUT.names)


def encoded(turns: Column, spark: SparkSession, vocabulary: str, template: Template, learn: tuple[str, ...]) -> Column:
    with open(vocabulary, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf(_OUT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors
        tok = Tokenizer.from_str(sent.value)
        tok.post_processor = processors.ByteLevel(trim_offsets=False)        # a token's offsets hold its spaces
        tok.add_special_tokens([template.turn, template.text, template.end])  # so no token runs over a mark
        yield from encodings(batches, tok, template, learn, AT_ONCE)
    return encode(turns)


def formatted(conversations: DataFrame, vocabulary: str = VOCABULARY, template: Template | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, tokens, loss (a flag for each token), loss_spans.

    Rows of one conv_id are its turns, by turn (null last), then role and text; a null role or text is empty, a null
    conv_id is a conversation too. Repeated rows are repeated turns. A conversation is rendered whole and encoded once,
    in one row: a task holds as many turns as its longest conversation has, and encodes AT_ONCE bytes at a time. An empty
    table gives no rows.
    """
    template = template or Template()
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return talks.select("conv_id", encoded(turns, conversations.sparkSession, vocabulary, template, learn).alias("e")).select("conv_id", "e.*")


def read_back(template: Template | None = None):
    """A column function of (formatted, loss_spans): what can be read from the output of ``formatted``."""
    template = template or Template()
    kind = T.StructType([T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType())])

    @F.arrow_udf(kind)
    def read(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in (row for t, s in pieces(AT_ONCE, texts, spans) for row in zip(t.to_pylist(), s.to_pylist(), strict=True)):
            turns = template.read(text)
            loss = "".join(template.unescape(text[s["start"]:s["end"]]) for s in own)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        return pa.StructArray.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))], names=kind.names)
    return read


_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       cast(sum(23 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS bigint) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op7_chat_masks", _SQL)
def op7(spark: SparkSession, path: str) -> DataFrame:
    talks = table(spark, path, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], talks.schema)
    out = formatted(talks.union(more))
    read = read_back()
    return out.select("conv_id", read("formatted", "loss_spans").alias("r"), F.length("formatted").cast("long").alias("formatted_chars")).select("conv_id", "r.*", "formatted_chars")
