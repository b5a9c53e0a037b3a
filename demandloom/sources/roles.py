"""What the columns of a source are good for, and which source holds what a job needs.

A source is profiled by one aggregate; names are matched by a join of profiles and patterns; the best column of a role and the
sources that hold all wanted roles are aggregates again. Sources may have any columns.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..config import ROLE_PATTERNS, Roles
from ..functions import dates as D
from ..functions import text as T
from ..functions.forecast import let

#: Share of rows that must hold a date, in a column that may serve as one.
DATE_SHARE = 0.75
#: Roles without which a source is no table of sales.
SALES_ROLES = ("date", "model", "installation_quantity", "revenue")
MEASURES = ("installation_quantity", "revenue")
#: How a text begins that may be a number: a word is told apart faster than by a failed cast.
NUMBER_LIKE = r"^[\x00-\x20]*[0-9+.NnIi-]"


def kind_of(t: TY.DataType) -> str:
    return "date" if isinstance(t, TY.DateType | TY.TimestampType | TY.TimestampNTZType) else "numeric" if isinstance(t, TY.NumericType) else "text"


def column_facts(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, place, column, kind, rows, dates, date_candidate): one pass over each source's cells.

    A column may serve as a date when at least DATE_SHARE of its rows hold one and they differ, and its name says so or the dates lie
    in more than two months or on more than one day of the month. Months and days are sets of a fixed range, so nothing is gathered
    that grows with the rows.
    """
    out = None
    for name, df in sources.items():
        kinds = [kind_of(f.dataType) for f in df.schema.fields]
        none, day = lambda t: F.lit(None).cast(t), lambda c: F.col(c).cast("date")
        cells = []
        for i, (f, k) in enumerate(zip(df.schema.fields, kinds, strict=True)):
            c, text = F.col(f"`{f.name}`"), F.trim(F.col(f"`{f.name}`").cast("string"))
            # a date is one already, within the years that a text may name; a number is read as its text would be, a FLOAT by that text
            v, num, d = ((none("string"), none("double"), F.when(F.year(day(f"`{f.name}`")).between(1900, 2100), day(f"`{f.name}`"))) if k == "date" else
                         (none("string"), c.cast("double"), none("date")) if k == "numeric" and not isinstance(f.dataType, TY.FloatType) else
                         (text, F.when(text.rlike(NUMBER_LIKE), text.try_cast("double")), none("date")))
            cells.append(F.struct(F.lit(i).alias("place"), v.alias("v"), num.alias("num"), d.alias("d")))
        # cells are read where they are and only the dates they hold, a fixed range, are counted across tasks
        # written dates, long code for few cells, stand in a lambda, which keeps the code for all cells small enough to be compiled
        written = F.when(F.col("c.v").rlike("[0-9]{4}"), let(F.col("c.v"), D.written_date))
        found = F.coalesce("c.d", F.when(F.col("c.num").isNotNull(), D.number_date(F.col("c.num"))).otherwise(written))
        values = df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.place", found.alias("d")).agg(F.count(F.lit(1)).alias("n"))
        month, day = F.collect_set(F.year("d") * 12 + F.month("d")), F.collect_set(F.dayofmonth("d"))
        per = values.groupBy("place").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("n"))), F.lit(0)).alias("dates"),
                                          (F.min("d") < F.max("d")).alias("differ"), ((F.size(month) > 2) | (F.size(day) > 1)).alias("spread"))
        known = df.sparkSession.createDataFrame([(name, i, f.name, k) for i, (f, k) in enumerate(zip(df.schema.fields, kinds, strict=True))], "source string, place int, column string, kind string")
        one = known.join(per, "place", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "dates": F.coalesce("dates", F.lit(0)), "spread": F.coalesce("spread", F.lit(False))})
        out = one if out is None else out.unionByName(one)
    candidate = (F.col("dates") >= DATE_SHARE * F.col("rows")) & F.coalesce("differ", F.lit(False)) & (T.has_date_hint(F.col("column")) | F.col("spread"))
    return out.select("source", "place", "column", "kind", "rows", "dates", candidate.alias("date_candidate"))


def role_scores(facts: DataFrame, patterns: dict[str, list[str]] = ROLE_PATTERNS) -> DataFrame:
    """(source, role, place, column, kind, date_candidate, score) of every column and role: 4 for a name that is a pattern, 2 for one that
    ends with it, 1 for one that holds it; dates and numbers count more where the role is one."""
    spark = facts.sparkSession
    known = spark.createDataFrame([(i, r, p) for i, (r, ps) in enumerate(patterns.items()) for p in ps], "role_no int, role string, pattern string")
    name, p = F.col("token"), F.col("pattern")
    match = F.when(name == p, 4).when(name.endswith(p), 2).when(F.contains(name, p), 1).otherwise(0)
    s = (facts.withColumn("token", T.token_string(F.col("column"))).crossJoin(F.broadcast(known))                # the patterns: a fixed list
         .groupBy("source", "role", "place", "column", "kind", "date_candidate").agg(F.sum(match).alias("name_score")))
    as_date = (F.col("role") == "date") & F.col("date_candidate")
    extra = (F.when(as_date & (F.col("kind") == "date"), 4).when(as_date, 2)
             .when(F.col("role").isin(*MEASURES) & (F.col("name_score") > 0) & (F.col("kind") == "numeric"), 1).otherwise(0))
    return s.withColumn("score", (F.col("name_score") + extra).cast("int")).drop("name_score")


def roles(facts: DataFrame, patterns: dict[str, list[str]] = ROLE_PATTERNS) -> DataFrame:
    """(source, role, column, score, date_candidate): the best column of each role, the first of equals; roles without one are left out.

    A source whose names tell of no date takes its first column that may serve as one, with score 0.
    """
    best = role_scores(facts, patterns).filter("score > 0").groupBy("source", "role").agg(
        F.max_by(F.struct("column", "score", "date_candidate"), F.struct("score", -F.col("place"))).alias("b")).select("source", "role", "b.*")
    first = facts.filter("date_candidate").groupBy("source").agg(F.min_by("column", "place").alias("column")).select(
        "source", F.lit("date").alias("role"), "column", F.lit(0).alias("score"), F.lit(True).alias("date_candidate"))
    return best.unionByName(first.join(best.filter("role = 'date'"), "source", "left_anti"))


def holding(found: DataFrame, sources: list[str], needed: tuple[str, ...] = SALES_ROLES) -> DataFrame:
    """(source, held, missing, complete): which of the needed roles each source holds. A date counts only where the column holds dates."""
    spark = found.sparkSession
    wanted = spark.createDataFrame([(i, s, j, r) for i, s in enumerate(sources) for j, r in enumerate(needed)], "place int, source string, role_no int, role string")
    usable = found.filter((F.col("role") != "date") | F.col("date_candidate")).select("source", "role", F.lit(True).alias("held"))
    gone = F.transform(F.array_sort(F.collect_list(F.when(F.col("held").isNull(), F.struct("role_no", "role")))), lambda x: x["role"])
    return (wanted.join(usable, ["source", "role"], "left").groupBy("place", "source").agg(F.count("held").cast("int").alias("held"), F.array_join(gone, ",").alias("missing"))
            .withColumn("complete", F.col("missing") == "").select("place", "source", "held", "missing", "complete"))


def choose(found: DataFrame, sources: list[str], requested: str | None = None, canonical: str | None = None, needed: tuple[str, ...] = SALES_ROLES) -> str:
    """The source of a job: the one of the canonical name, else the requested one, else the first that holds all needed roles.

    Raises ValueError with what each source lacks if none does. Reads one row a source.
    """
    for s in sources:
        if canonical and s.strip().lower() == canonical.lower():
            return s
    rows = {r.source: r.missing for r in holding(found, sources, needed).collect()}
    for s in ([requested] if requested in rows else []) + sources:
        if not rows[s]:
            return s
    raise ValueError("no source holds all of " + ", ".join(needed) + ": " + "; ".join(f"{s} lacks {m}" for s, m in rows.items()))


def named(sources: list[str], word: str) -> list[str]:
    """Sources whose names hold a word, in their order."""
    return [s for s in sources if word in s.lower()]


def as_roles(found: DataFrame, source: str) -> Roles:
    """The columns of a source as the settings that the operators take; a role without a column keeps its usual name."""
    rename = {"installation_quantity": "quantity"}
    got = {rename.get(r.role, r.role): r.column for r in found.filter(F.col("source") == source).collect()}
    return Roles(**{k: v for k, v in got.items() if k in {f.name for f in fields(Roles)}})

