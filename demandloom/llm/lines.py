"""Line dedup by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .registry import query

#: Levels of the tree below the token count: leading tokens that lines of one leaf share.
DEPTH = 4
#: Shorter lines say too little to be called boilerplate.
MIN_TOKENS = 8

#: A line ends at a line feed, a sentence of it after a full stop or question mark and a space.
_LINES, _SENTENCES = r"(?<=\n)", r"(?<= )(?<=[.?] )"


def tokens(line: Column) -> Column:
    """Words of a line; a run of digits is a variable field, whatever its length."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(line, r"[0-9]+", "*"), r"[\x00-\x20]+", " ")), " ")


def templates(words: Column, depth: int = DEPTH) -> Column:
    """The two templates of a line, as hashes.

    The path in the tree is the token count and then the leading tokens; what follows is halved, and each template
    keeps one half and leaves the other open. So lines of one leaf that differ in one place, however long, share a
    template, and lines that share one agree in their leading tokens and in half of the rest.
    """
    n = F.size(words)
    half = F.ceil((n - depth) / F.lit(2)).cast("int")
    lead = F.slice(words, F.lit(1), F.lit(depth))
    front, back = F.slice(words, F.lit(depth + 1), half), F.slice(words, half + (depth + 1), n - depth - half)
    return F.array(F.xxhash64(F.lit(0), n, lead, front), F.xxhash64(F.lit(1), n, lead, back))


def _order(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1))


def recurring(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(ord, units): for each document, hashes of its lines and sentences of which an earlier document has a template."""
    line = docs.select(_order(docs).alias("ord"), F.explode(F.split("text", _LINES)).alias("line"))
    unit = line.select("ord", "line", F.explode(F.array(F.split("line", _SENTENCES))).alias("parts"))
    unit = unit.select("ord", F.explode(F.concat(F.when(F.size("parts") > 1, F.array("line")).otherwise(F.array().cast("array<string>")), F.col("parts"))).alias("unit"))
    words = unit.select("ord", F.xxhash64("unit").alias("unit"), F.explode(F.array(tokens(F.col("unit")))).alias("w")).where(F.size("w") >= min_tokens)
    keys = cut(words.select("ord", "unit", F.explode(templates(F.col("w"), depth)).alias("key")))
    first = keys.groupBy("key").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").select("key", "first")
    return keys.join(first, "key").where("ord > first").groupBy("ord").agg(F.collect_set("unit").alias("units"))


def _left(text: Column, units: Column) -> Column:
    """``text`` without the lines and sentences whose hash is in ``units``."""
    gone = lambda unit: F.array_contains(units, F.xxhash64(unit))

    def kept(line: Column) -> Column:
        rest = F.array_join(F.filter(F.split(line, _SENTENCES), lambda s: ~gone(s)), "")
        ended = lambda r: F.when((r != "") & line.endswith("\n") & ~r.endswith("\n"), F.concat(F.rtrim(r), F.lit("\n"))).otherwise(r)
        return F.when(gone(line), F.array(F.lit(""))).otherwise(F.transform(F.array(rest), ended))[0]
    return F.array_join(F.transform(F.split(text, _LINES), kept), "")


def dedup_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with all their columns and rows, ``text`` without lines that recur across documents.

    A line, or a sentence inside one, of ``min_tokens`` or more words goes if a document of smaller doc_id has one of
    its templates; so the first document keeps it. Everything else stays as it is, white space included. A line of
    which some sentences go keeps its line feed.

    Lines that recur only inside one document (also inside rows that repeat a doc_id) stay. A null doc_id comes last;
    documents without one count as one document. A null text stays null, a text all of whose lines go becomes empty,
    an empty table stays empty. A line of any length is one template.
    """
    found = recurring(docs, depth, min_tokens).select(F.col("ord").alias("__ord"), F.col("units").alias("__units"))
    both = docs.withColumn("__own", _order(docs)).join(found, F.col("__own") == F.col("__ord"), "left")
    text = F.when(F.col("__units").isNull(), F.col("text")).otherwise(_left(F.col("text"), F.col("__units")))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


_SQL = r"""
WITH l AS (SELECT doc_id, ln, unnest(string_split(regexp_replace(line, '([.?] )', '\1' || chr(1), 'g'), chr(1))) AS piece,
                  generate_subscripts(string_split(regexp_replace(line, '([.?] )', '\1' || chr(1), 'g'), chr(1)), 1) AS pn, line
           FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(1)), chr(1))) AS line,
                        generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(1)), chr(1)), 1) AS ln FROM documents)),
w AS (SELECT doc_id, ln, pn, piece, line, string_split(trim(regexp_replace(regexp_replace(piece, '[0-9]+', '*', 'g'), '[\x01-\x20]+', ' ', 'g')), ' ') AS p,
             string_split(trim(regexp_replace(regexp_replace(line, '[0-9]+', '*', 'g'), '[\x01-\x20]+', ' ', 'g')), ' ') AS q FROM l),
k AS (SELECT *, cast(ceil((len(p) - 4) / 2) AS int) AS ph, cast(ceil((len(q) - 4) / 2) AS int) AS qh FROM w),
t AS (SELECT doc_id, ln, pn, piece, line,
             CASE WHEN len(p) >= 8 THEN [concat_ws(' ', 'a', len(p), array_to_string(p[1:4 + ph], ' ')), concat_ws(' ', 'b', len(p), array_to_string(p[1:4], ' '), array_to_string(p[5 + ph:], ' '))] ELSE [] END AS pk,
             CASE WHEN len(q) >= 8 THEN [concat_ws(' ', 'a', len(q), array_to_string(q[1:4 + qh], ' ')), concat_ws(' ', 'b', len(q), array_to_string(q[1:4], ' '), array_to_string(q[5 + qh:], ' '))] ELSE [] END AS qk FROM k),
f AS (SELECT key, min(doc_id) AS doc FROM (SELECT doc_id, unnest(list_concat(pk, qk)) AS key FROM t) GROUP BY key),
x AS (SELECT DISTINCT t.doc_id, t.ln, t.pn, true AS gone FROM (SELECT doc_id, ln, pn, unnest(pk) AS key FROM t) t JOIN f ON t.key = f.key AND f.doc < t.doc_id),
y AS (SELECT DISTINCT t.doc_id, t.ln, true AS gone FROM (SELECT doc_id, ln, unnest(qk) AS key FROM t) t JOIN f ON t.key = f.key AND f.doc < t.doc_id),
r AS (SELECT t.doc_id, t.ln, any_value(line) AS line, bool_or(y.gone IS NOT NULL) AS all_gone, coalesce(string_agg(CASE WHEN x.gone IS NULL THEN piece ELSE '' END, '' ORDER BY t.pn), '') AS rest
      FROM t LEFT JOIN x ON t.doc_id = x.doc_id AND t.ln = x.ln AND t.pn = x.pn LEFT JOIN y ON t.doc_id = y.doc_id AND t.ln = y.ln GROUP BY t.doc_id, t.ln),
z AS (SELECT doc_id, string_agg(CASE WHEN all_gone THEN '' WHEN rest <> '' AND suffix(line, chr(10)) AND NOT suffix(rest, chr(10)) THEN rtrim(rest) || chr(10) ELSE rest END, '' ORDER BY ln) AS text FROM r GROUP BY doc_id)
SELECT d.doc_id, sha256(z.text) AS text_sha256, length(z.text) AS n_chars, length(d.text) - length(z.text) AS dropped_chars
FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id
"""


@query("op3_template_line_dedup", _SQL)
def op3(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    after = dedup_lines(docs.select("doc_id", "text", F.length("text").alias("was")))
    return after.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), (F.col("was") - F.length("text")).cast("long").alias("dropped_chars"))
