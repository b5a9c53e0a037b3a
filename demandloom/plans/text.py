"""Queries: words, chunks and retrieval."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import explore as XP
from ..operators import forecasting as FO
from ..operators import retrieval as X
from ..sources import planning as P
from . import inputs as I
from .base_sql import block
from .explore import TYPES
from .registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TOK = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+')), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"
CHUNK = lambda c: (f"list_filter(list_transform(list_transform(regexp_split_to_array({c}, '\\n\\s*\\n'), lambda b: trim(regexp_replace(b, '\\s+', ' ', 'g'))), "
                   "lambda b: CASE WHEN length(b) > 360 THEN rtrim(b[1:357]) || '...' ELSE b END), lambda b: length(b) >= 40)")


PARAGRAPH = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, '\\n\\s*\\n'), lambda b: trim(regexp_replace(b, '\\s+', ' ', 'g'))), lambda b: length(b) >= 40)"


def questions(spark, path):
    """Every user turn of every conversation."""
    c = P.table(spark, path, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'")
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("question_id"), "text", F.when(F.col("conv_id") % 5 == 0, "the").otherwise("").alias("focus"), (F.col("conv_id") % 3).alias("scope"))


def docs(spark, path):
    return P.table(spark, path, "documents", "doc_id", "text", "source")


@query("F21_tokens", f"SELECT doc_id, len(t) AS n, array_to_string(list_slice(list_sort(t), 1, 5), ',') AS first FROM (SELECT doc_id, {TOK('text')} AS t FROM documents)")
def f21(spark, path):
    t = docs(spark, path).withColumn("t", F.array_sort(T.tokens(F.col("text"))))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.slice("t", 1, 5), ",").alias("first"))


@query("F22_chunks", f"SELECT doc_id, i, length(c[i]) AS chars, md5(c[i]) AS digest FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {CHUNK('text')} AS c FROM documents))")
def f22(spark, path):
    c = docs(spark, path).select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("i", "c"))
    return c.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), F.length("c").cast("long").alias("chars"), F.md5("c").alias("digest"))


_FW, _CW = "|".join(X.FORECAST_WORDS), "|".join(X.CHANGE_WORDS)


@query("X2_intent", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '{_FW}') THEN 'forecast' WHEN regexp_matches(lower(text), '{_CW}') THEN 'change' ELSE 'overview' END AS intent FROM conversations""")
def x2(spark, path):
    return P.table(spark, path, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", X.intent(F.col("text")).alias("intent"))


block("b_q", "SELECT conv_id * 100000 + turn AS question_id, text, CASE WHEN conv_id % 5 = 0 THEN 'the' ELSE '' END AS focus, conv_id % 3 AS scope FROM conversations WHERE role = 'user'")
block("b_snip", f"SELECT doc_id || '-' || (i - 1) AS snippet_id, 'document ' || doc_id || ' section ' || i AS title, c[i] AS content, source AS src FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, source, {PARAGRAPH('text')} AS c FROM documents))")


@query("X1_ranked_context", f"""WITH q AS (SELECT question_id, focus, unnest({TOK('text')}) AS w FROM b_q), s AS (SELECT *, title || ' ' || content || ' ' || src || ' knowledge' AS txt FROM b_snip),
st AS (SELECT snippet_id, unnest({TOK('txt')}) AS w FROM s), o AS (SELECT question_id, snippet_id, count(*) AS n FROM q JOIN st USING (w) GROUP BY ALL),
r AS (SELECT b_q.question_id, s.snippet_id, title, round(0.6::DOUBLE + coalesce(n, 0) * 2.0::DOUBLE + CASE WHEN b_q.focus <> '' AND contains(lower(txt), lower(b_q.focus)) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END, 2) AS score
 FROM b_q CROSS JOIN s LEFT JOIN o ON o.question_id = b_q.question_id AND o.snippet_id = s.snippet_id),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, title, snippet_id) AS position FROM r)
SELECT question_id, snippet_id, score, CAST(position AS INT) AS position FROM k WHERE position <= 6""")
def x1(spark, path):
    return X.rank_context(questions(spark, path), X.document_snippets(docs(spark, path)))


@query("X4_memory_matches", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY turn DESC, conv_id DESC) AS k, {TOK('text')} AS mt FROM conversations WHERE role = 'assistant'),
j AS (SELECT question_id, m.conv_id * 1000 + m.turn AS memory_id, k, len(list_intersect({TOK('b_q.text')}, mt)) AS overlap FROM b_q JOIN m ON b_q.scope = m.conv_id % 3 WHERE k <= 12),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY k) AS position FROM j WHERE overlap > 0)
SELECT question_id, memory_id, overlap, overlap + 1.0::DOUBLE AS base_score, CAST(position AS INT) AS position FROM p WHERE position <= 3""")
def x4(spark, path):
    c = P.table(spark, path, "conversations", "conv_id", "turn", "role", "text").filter("role = 'assistant'")
    m = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), (F.col("conv_id") % 3).alias("scope"), F.col("turn").alias("created"), F.col("conv_id"),
                 "text", F.lit("").alias("focus"))
    r = X.memory_matches(questions(spark, path), m.withColumn("created", F.col("created") * 10000000 + F.col("conv_id")).drop("conv_id"))
    return r.withColumn("overlap", F.col("overlap").cast("long"))


@query("X6_focus_part", """WITH w AS (SELECT question_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS w FROM b_q), h AS (SELECT question_id, min(part_number) AS hit FROM w JOIN b_part ON w.w = lower(part_number) GROUP BY 1)
SELECT question_id, coalesce(nullif(focus, ''), hit, '77') AS part_number FROM b_q LEFT JOIN h USING (question_id)""")
def x6(spark, path):
    return X.focus_part(questions(spark, path), P._parts(spark, path), "77")


@query("X3_risk_and_actions")
def x3(spark, path):
    d = FO.rate(FO.part_series(I.sales(spark, path)))
    none = F.lit(None).cast("string")
    return d.select("part_number", X.analyst_risk(F.col("risk"), F.col("confidence"), F.col("b_wape"), F.col("r_code")).alias("risk_level"),
                    F.array_join(X.actions(F.col("r_code"), F.col("risk"), F.col("b_bias"), none, none), ",").alias("actions"))


@query("X5_context_table")
def x5(spark, path):
    from .forecasting import exposure
    s = I.sales(spark, path, model_year=True)
    alerts = FO.alerts(I.sales(spark, path), exposure(spark, path))
    t = X.result_snippets(XP.column_profile(s, TYPES), alerts, XP.kpis(s)).unionByName(X.document_snippets(docs(spark, path)))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("snippets"), F.max("base_score").alias("best_base"), F.min("priority").alias("priority"))
