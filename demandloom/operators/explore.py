"""Filters, facets, pivots, profiles, chart tables and rankings over sales and facts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Roles
from ..functions import dates as D
from ..functions import text as T
from ..session import materialize

ROLES = Roles()


# --- filters ---------------------------------------------------------------------

@dataclass(frozen=True)
class Filters:
    """Values to keep per facet; an empty entry keeps everything."""

    search: str = ""
    brand: tuple[str, ...] = ()
    model: tuple[str, ...] = ()
    model_year: tuple[str, ...] = ()
    part: tuple[str, ...] = ()
    model_query: str = ""
    part_query: str = ""
    start_date: str = ""
    end_date: str = ""


def _all(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _has(c: Column, text: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))


def search_condition(search: str, columns: list[str]) -> Column:
    """Every word must occur somewhere in the joined, lower-cased columns."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return _all([F.contains(joined, F.lit(w)) for w in search.lower().split()])


def facet_conditions(f: Filters, roles: Roles = ROLES) -> dict[str, Column]:
    """One condition per facet, plus 'base' for the ones that are never excluded."""
    part = F.col(roles.part_description)
    base = []
    if f.start_date:
        base.append(F.col(roles.date) >= F.lit(f.start_date).cast("timestamp"))
    if f.end_date:                        # compares with midnight of the end day
        base.append(F.col(roles.date) <= F.lit(f.end_date).cast("timestamp"))
    if f.model_query:
        base.append(_has(F.col(roles.model), f.model_query))
    if f.part_query:
        base.append(_has(part, f.part_query))
    if f.search:
        base.append(search_condition(f.search, [roles.brand, roles.model, roles.part_number,
                                                roles.part_description, roles.model_code, roles.plc]))
    pick = lambda c, vals: F.coalesce(c, F.lit("")).isin(*vals) if vals else F.lit(True)
    return {"base": _all(base), "brand": pick(F.col(roles.brand), f.brand),
            "model": pick(F.col(roles.model), f.model), "model_year": pick(F.col(roles.model_year), f.model_year),
            "part": pick(part, f.part)}


def apply_filters(df: DataFrame, f: Filters, roles: Roles = ROLES) -> DataFrame:
    return df.filter(_all(facet_conditions(f, roles).values()))


def date_range_inclusive(df: DataFrame, start: str, end: str, column: str = ROLES.date) -> DataFrame:
    """Both days included to their last second; null dates drop out."""
    last = F.lit(end).cast("timestamp") + F.expr("interval 1 day") - F.expr("interval 1 second")
    return df.filter(F.col(column).cast("timestamp").between(F.lit(start).cast("timestamp"), last))


def filter_planning_sources(facts: DataFrame, wl: DataFrame, *, brand=(), model=(), part=(), start: str = "",
                            end: str = "", anchors=("HMA", "GMA", "KUS")) -> tuple[DataFrame, DataFrame]:
    """Filter facts and let wholesale follow the anchors that survive."""
    if brand:
        a, b = [x for x in brand if x in anchors], [x for x in brand if x not in anchors]
        cond = F.lit(False)
        cond = cond | F.col("anchor_brand").isin(*a) if a else cond
        cond = cond | F.col("brand").isin(*b) if b else cond
        facts = facts.filter(cond)
        live = facts.select("anchor_brand").distinct()
        keep = wl.join(live, "anchor_brand", "left_semi")
        wl = keep if not a else keep.unionByName(wl.filter(F.col("anchor_brand").isin(*a))).distinct()
    if model:
        facts, wl = facts.filter(F.col("model_name").isin(*model)), wl.filter(F.col("model_name").isin(*model))
    if part:
        facts = facts.filter(F.col("part_number").isin(*part) | F.col("plc").isin(*part))
    for cond in ([F.col("month") >= start[:7]] if start else []) + ([F.col("month") <= end[:7]] if end else []):
        facts, wl = facts.filter(cond), wl.filter(cond)
    return facts, wl


def cutoff_context(sales: DataFrame, end_date: str = "") -> DataFrame:
    """Latest date, whether its month is complete, and the completed cutoff month; one row."""
    d = F.col("latest_date")
    req = F.lit(end_date).cast("date") if end_date else None
    earlier = (D.month_of(req) < D.month_of(d)) if end_date else F.lit(False)
    return sales.agg(F.max(ROLES.date).alias("latest_date")).select(
        d.cast("string").alias("latest_date"),
        F.when(earlier, F.lit(True)).otherwise(D.month_is_complete(d)).alias("latest_complete"),
        (F.when(earlier, F.last_day(req)).otherwise(d) if end_date else d).cast("string").alias("effective_date"),
        D.completed_cutoff(d, req).alias("cutoff_month"))


def drop_partial_part_months(sales: DataFrame) -> DataFrame:
    """Per part: drop its latest month when it ends before month end and on day 27 or earlier."""
    last = sales.groupBy("part_number").agg(F.max("sale_date").alias("__last"))
    partial = (F.col("__last") < F.last_day("__last")) & (F.dayofmonth("__last") <= 27)
    same = F.trunc("sale_date", "month") == F.trunc("__last", "month")
    return sales.join(last, "part_number").filter(~(partial & same)).drop("__last")


def volume_completeness(facts: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Latest month total against the median of the three months before it; one row."""
    m = facts.groupBy("month").agg(F.sum("quantity").alias("quantity"))
    top4 = m.orderBy(F.desc("month")).limit(4)            # the rule only looks at four months
    rows = top4.agg(F.max("month").alias("latest_month"), F.max_by("quantity", "month").alias("latest_quantity"),
                    F.array_sort(F.collect_list(F.struct("month", "quantity"))).alias("a"))
    prior = F.transform(F.slice("a", 1, F.size("a") - 1), lambda x: x["quantity"])
    med = median_of(prior)
    ratio = F.col("latest_quantity") / F.nullif(med, F.lit(0.0))
    return rows.select("latest_month", "latest_quantity", med.alias("prior_median"), ratio.alias("ratio"),
                       F.coalesce(ratio >= threshold, F.lit(True)).alias("supports_complete"))


def median_of(a: Column) -> Column:
    """Median of a short array."""
    s, n = F.array_sort(a), F.size(a)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.get(s, lo - 1) + F.get(s, hi - 1)) / 2)


# --- facets and pivots -------------------------------------------------------------

# fixed values: facets with their limits
FACETS = (("brand", 25, True), ("model", 80, True), ("model_year", 20, False), ("part", 120, True))


def facet_options(df: DataFrame, f: Filters, roles: Roles = ROLES) -> DataFrame:
    """Value counts per facet with all *other* filters applied: one scan, one shuffle."""
    cond = facet_conditions(f, roles)
    cols = {"brand": roles.brand, "model": roles.model, "model_year": roles.model_year, "part": roles.part_description}
    entries = []
    for name, _, _ in FACETS:
        others = _all([c for k, c in cond.items() if k != name])
        entries.append(F.when(others, F.struct(F.lit(name).alias("facet"), F.col(cols[name]).cast("string").alias("value"))))
    counts = (df.select(F.explode(F.array(*entries)).alias("e")).filter("e is not null").select("e.*")
              .filter(F.trim("value") != "").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))
    by_count = F.col("facet").isin(*[n for n, _, c in FACETS if c])
    w = Window.partitionBy("facet").orderBy(F.when(by_count, -F.col("n")).otherwise(0), "value")
    limit = reduce(lambda a, x: a.when(F.col("facet") == x[0], x[1]), FACETS[1:], F.when(F.col("facet") == FACETS[0][0], FACETS[0][1]))
    top = max(n for _, n, _ in FACETS)
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top).filter(F.col("position") <= limit)


def part_options(df: DataFrame, limit: int = 120) -> DataFrame:
    g = (df.filter(T.blank("part_number") != "").groupBy("part_number")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"),
              F.mode("part_description", True).alias("description")))
    return g.orderBy(F.desc("quantity"), F.desc("n"), "part_number").limit(limit)


def pivot(df: DataFrame, rows: list[Column], cols: list[Column], value: Column, how: str = "sum",
          max_rows: int | None = None, max_cols: int | None = None) -> DataFrame:
    """Long pivot: cells, row totals, column totals and the grand total, each from base rows.

    ``max_rows`` / ``max_cols`` keep the keys with the largest totals (a display limit, off by default).
    """
    base = df.select(T.composite_key(*rows).alias("row_key"), T.composite_key(*cols).alias("col_key"),
                     F.coalesce(value.cast("double"), F.lit(0.0)).alias("v"))
    agg = {"sum": F.sum("v"), "avg": F.avg("v"), "count": F.count("v").cast("double")}[how]
    out = (base.groupingSets([("row_key", "col_key"), ("row_key",), ("col_key",), ()], "row_key", "col_key")
           .agg(agg.alias("value"), F.grouping_id().alias("gid")))
    level = F.when(F.col("gid") == 0, "cell").when(F.col("gid") == 1, "row_total").when(
        F.col("gid") == 2, "col_total").otherwise("grand_total")
    out = out.select(level.alias("level"), F.coalesce("row_key", F.lit("")).alias("row_key"),
                     F.coalesce("col_key", F.lit("")).alias("col_key"), F.round("value", 2).alias("value"))
    for key, lvl, cap in (("row_key", "row_total", max_rows), ("col_key", "col_total", max_cols)):
        if cap:
            keep = (out.filter(F.col("level") == lvl).orderBy(F.desc("value"), key).limit(cap).select(key))
            out = out.filter(F.col("level").isin("grand_total", "col_total" if key == "row_key" else "row_total")).unionByName(
                out.filter(F.col("level").isin("cell", lvl)).join(keep, key, "left_semi").select(out.columns))
    return out


def dimension(key: str, roles: Roles = ROLES) -> Column:
    """Pivot dimension of a dated table; null shows as ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return {"brand": text(roles.brand), "model": text(roles.model), "model_year": text(roles.model_year),
            "part": text(roles.part_description),
            "month": F.coalesce(D.month_of(roles.date), F.lit("")),
            "year": F.coalesce(F.date_format(roles.date, "yyyy"), F.lit(""))}[key]


def measure(key: str, roles: Roles = ROLES) -> Column:
    return {"quantity": F.col(roles.quantity), "revenue": F.col(roles.revenue).cast("double")}.get(key, F.lit(1.0))


def pivot_catalog(columns: list[str], roles: Roles = ROLES, channels: int = 0) -> dict[str, list[str]]:
    """Dimensions and measures a table can offer, from its column names."""
    dims = [k for k, c in (("brand", roles.brand), ("model", roles.model), ("model_year", roles.model_year),
                           ("part", roles.part_description)) if c in columns]
    dims += ["channel"] if channels > 1 else []
    dims += ["month", "year"] if roles.date in columns else []
    meas = [k for k, c in (("quantity", roles.quantity), ("revenue", roles.revenue)) if c in columns]
    return {"dimensions": dims, "measures": meas + ["records"]}


# --- exact order statistics at scale ------------------------------------------------

#: Distinct values of a bucket that one task may sort; a bucket with more that holds a wanted rank is split again.
MOST_SORTED = 100_000
#: Parts that such a bucket is split into, by its own range.
PARTS = 1024
#: Up to so many wanted buckets are sent to all tasks (about 100 bytes each); beyond, they meet the values in a join.
MOST_SENT = 10_000


def value_counts(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(groups..., b, v, n): distinct values with their number of rows and an order-preserving bucket ``b``; written once, read by all
    steps that follow. Values of a bucket differ by 1.1 % at most."""
    g, v = groups or [], F.col("v")
    counts = (df.select(*g, F.col(value).cast("double").alias("v")).filter("v is not null")
              .groupBy(*g, "v").agg(F.count(F.lit(1)).alias("n")))
    size = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(10 ** 9)).otherwise(F.floor(F.log2(F.abs(v)) * 64) + 200000)
    return materialize(counts.withColumn("b", F.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("bigint")))


def _holding_ranks(parts: DataFrame, whole: list[str], order: str, ranks: Column, before: Column) -> DataFrame:
    """Of ``parts`` (with bn rows each) those that hold a wanted rank: before counts the rows ahead of a part."""
    w = Window.partitionBy(*(whole or [F.lit(0)])).orderBy(order)
    ahead = parts.withColumn("before", before + F.sum("bn").over(w) - F.col("bn"))
    return ahead.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("bn")))).filter(F.size("ranks") > 0)


def rank_buckets(counts: DataFrame, qs: list[float], groups: list[str] | None = None, most: int = MOST_SORTED) -> DataFrame:
    """(groups..., b, lo, hi, before, total, ranks, m): value ranges that hold the wanted ranks, none with more than ``most``
    distinct values m. Buckets come first; one that is too large is split by its own range, again and again: as the values of a
    bucket share their sign and nearly their size, five or six splits tell any two doubles apart."""
    g = groups or []
    sizes = [F.sum("n").alias("bn"), F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    per = counts.groupBy(*g, "b").agg(*sizes).withColumn("total", F.sum("bn").over(Window.partitionBy(*(g or [F.lit(0)]))))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("total") - 1) * q), F.ceil((F.col("total") - 1) * q)) for q in qs])))
    names = [*g, "b", "lo", "hi", "before", "total", "ranks", "m"]
    found = materialize(_holding_ranks(per, g, "b", wanted, F.lit(0)).select(*names))
    large = (F.col("m") > most) & (F.col("lo") < F.col("hi"))
    while found.filter(large).limit(1).count():
        inside = _in_ranges(counts, found.filter(large), g)
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))
        inner = [*g, "b", F.col("lo").alias("from"), F.col("before").alias("base"), "total", F.col("ranks").alias("ask"), part.alias("k")]
        split = inside.select(*inner, "v", "n").groupBy(*g, "b", "from", "base", "total", "ask", "k").agg(*sizes)
        found = materialize(found.filter(~large).unionByName(_holding_ranks(split, [*g, "b", "from"], "k", F.col("ask"), F.col("base")).select(*names)))
    return found


def _in_ranges(counts: DataFrame, ranges: DataFrame, g: list[str]) -> DataFrame:
    """Values that lie in one of the ranges of their group and bucket."""
    small = ranges.limit(MOST_SENT + 1).count() <= MOST_SENT
    return counts.join(F.broadcast(ranges) if small else ranges, [*g, "b"]).filter("v between lo and hi")


def percentiles_of(counts: DataFrame, qs: list[float], groups: list[str] | None = None, most: int = MOST_SORTED) -> DataFrame:
    """Linear-interpolated percentiles of counted values; a task sorts at most ``most`` distinct ones."""
    g, v = groups or [], F.col("v")
    inner = Window.partitionBy(*g, "b", "lo").orderBy("v")
    picked = (_in_ranges(counts, rank_buckets(counts, qs, g, most), g)
              .withColumn("upto", F.col("before") + F.sum("n").over(inner))
              .withColumn("r", F.explode(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto"))))))
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.max("total") - 1) * F.lit(float(q))
        lo = F.max(F.when(F.col("r") == F.floor((F.col("total") - 1) * q), v))
        hi = F.max(F.when(F.col("r") == F.ceil((F.col("total") - 1) * q), v))
        aggs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(f"q{i}"))
    return picked.groupBy(*g).agg(F.max("total").alias("n_values"), *aggs)


def exact_percentiles(df: DataFrame, value: str, qs: list[float], groups: list[str] | None = None) -> DataFrame:
    """Linear-interpolated percentiles without holding any group, or any part of one that grows with it, in one task."""
    return percentiles_of(value_counts(df, value, groups), qs, groups)


# --- profiles -----------------------------------------------------------------------

def column_profile(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Missing, distinct and sample values of every column; one narrow shuffle of (column, value)."""
    cols = list(types)
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("e")).select("e.*")
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("value").asc_nulls_last())
    samples = (counts.filter("value is not null").withColumn("k", F.row_number().over(w)).filter("k <= 3")
               .groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))),
                                                               lambda x: x["value"]), ", ").alias("samples")))
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct"))
    kind = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    return stats.join(samples, "column", "left").select(
        "column", kind[F.col("column")].alias("type"), "missing",
        F.round(F.col("missing") / F.col("rows") * 100, 1).alias("missing_pct"), "distinct",
        F.coalesce("samples", F.lit("")).alias("samples"))


# fixed values: groups of fields
FIELD_GROUPS = {"date": "Time", "brand": "Vehicle", "model": "Vehicle", "model_year": "Vehicle", "part_number": "Part",
                "part_description": "Part", "plc": "Part", "installation_quantity": "Quantity", "revenue": "Revenue"}


def classify_fields(profile: DataFrame, roles_by_column: dict[str, str]) -> DataFrame:
    """Business group and confidence of each profiled column."""
    role_map = F.create_map(*[x for c, r in roles_by_column.items() for x in (F.lit(c), F.lit(r))])
    group_map = F.create_map(*[x for r, g in FIELD_GROUPS.items() for x in (F.lit(r), F.lit(g))])
    role, low = F.try_element_at(role_map, F.col("column")), F.lower("column")
    group = (F.coalesce(F.try_element_at(group_map, role),
                        F.when(F.col("type") == "date", "Time").when(F.col("type") == "numeric", "Other")
                        .when(low.rlike("model|brand"), "Vehicle").when(low.rlike("part|desc"), "Part").otherwise("Other")))
    conf = F.when(role.isNotNull(), "High").when(group != "Other", "Medium").otherwise("Low")
    return profile.select("column", F.coalesce(role, F.lit("")).alias("role"), group.alias("field_group"), conf.alias("confidence"))


def kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum("quantity").alias("quantity"),
                  F.sum("revenue").cast("double").alias("revenue"), F.count_distinct("part_number").alias("parts"))


def overview(df: DataFrame) -> DataFrame:
    """Distinct names, date range and totals of a slice; blanks are not counted."""
    nn = lambda c: F.count_distinct(F.nullif(F.trim(c), F.lit("")))
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min("sale_date").cast("string").alias("min_date"),
                  F.max("sale_date").cast("string").alias("max_date"), nn("model_name").alias("models"),
                  nn("model_code").alias("model_codes"), nn("part_number").alias("parts"), nn("brand").alias("brands"),
                  F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").alias("quantity"))


def leaders(df: DataFrame) -> DataFrame:
    """Top brand and model by revenue, top part by quantity."""
    outs = []
    for kind, col, metric in (("brand", "brand", "revenue"), ("model", "model_name", "revenue"),
                              ("part", "part_description", "quantity")):
        outs.append(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("name"))
                    .agg(F.sum(metric).cast("double").alias("value"))
                    .orderBy(F.desc("value"), "name").limit(1)
                    .select(F.lit(kind).alias("kind"), "name", "value", F.lit(metric).alias("metric")))
    return reduce(lambda a, b: a.unionByName(b), outs)


def slice_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unit price, per-row means and completeness (100 - mean missing %)."""
    miss = reduce(lambda a, b: a + b, [F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 1) for c in columns]) / len(columns)
    rev, qty, n = F.sum("revenue").cast("double"), F.sum("quantity"), F.count(F.lit(1))
    return df.agg((rev / F.nullif(qty, F.lit(0.0))).alias("unit_price"), (qty / n).alias("qty_per_row"),
                  (rev / n).alias("revenue_per_row"), (100.0 - miss).alias("completeness"))


def data_quality(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing or blank values per role, long: (check, count, pct)."""
    aggs = [F.count_if(T.blank(c) == "").alias(k) for k, c in columns.items()]
    aggs += [F.count_if(F.col("revenue") < 0).alias("negative_revenue"), F.count_if(F.col("quantity") < 0).alias("negative_quantity"),
             F.count_if(F.col("quantity") == 0).alias("zero_quantity"), F.count(F.lit(1)).alias("n")]
    one = df.agg(*aggs)
    names = list(columns) + ["negative_revenue", "negative_quantity", "zero_quantity"]
    return one.unpivot(["n"], names, "check", "rows").select(
        "check", "rows", F.round(F.col("rows") / F.greatest(F.col("n"), F.lit(1)) * 100, 2).alias("pct"))


def unit_price_outliers(df: DataFrame) -> DataFrame:
    """Rows whose unit price lies outside the exact 1st..99th percentile."""
    price = df.select((F.col("revenue").cast("double") / F.nullif(F.col("quantity"), F.lit(0.0))).alias("p"))
    counts = value_counts(price, "p")
    bounds = percentiles_of(counts, [0.01, 0.99])
    outside = F.when((F.col("v") < F.col("q0")) | (F.col("v") > F.col("q1")), F.col("n")).otherwise(0)
    return (counts.crossJoin(F.broadcast(bounds))           # bounds is one row
            .groupBy("q0", "q1").agg(F.sum(outside).alias("outliers"))
            .select(F.col("q0").alias("p01"), F.col("q1").alias("p99"), "outliers"))


def description_conflicts(df: DataFrame, limit: int = 10) -> DataFrame:
    """Parts sold under several descriptions. Raw spellings are counted before they are gathered."""
    d = (df.select(F.trim("part_number").alias("part_number"), F.trim("part_description").alias("raw"))
         .filter("part_number <> '' and raw <> ''").groupBy("part_number", "raw").agg(F.count(F.lit(1)).alias("n")))
    norm = F.lower(F.regexp_replace("raw", r"\s+", " "))
    w = Window.partitionBy("part_number").orderBy("raw")
    g = (d.withColumn("k", F.row_number().over(w)).groupBy("part_number").agg(
        F.count_distinct(norm).alias("description_count"), F.count(F.lit(1)).alias("variant_count"),
        F.sum("n").alias("row_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "raw")))),
                                 lambda x: x["raw"]), " | ").alias("descriptions")).filter("variant_count > 1"))
    kind = F.when(F.col("description_count") > 1, "description_mismatch").otherwise("format_warning")
    return (g.withColumn("issue", kind).orderBy(F.asc("issue"), F.desc("description_count"), F.desc("row_count"), "part_number")
            .limit(limit))


# --- chart tables and rankings --------------------------------------------------------

def monthly_trend(df: DataFrame, metric: str) -> DataFrame:
    return (df.filter(F.col("sale_date").isNotNull()).groupBy(D.month_of("sale_date").alias("month"))
            .agg(F.sum(metric).cast("double").alias(metric)))


def chart_table(df: DataFrame, x: Column, value: Column, how: str, color: Column | None = None,
                top_n: int | None = None) -> DataFrame:
    """Bucketed aggregate; with ``top_n`` only the buckets with the largest sum of results."""
    base = df.select(F.coalesce(x.cast("string"), F.lit("Unknown")).alias("bucket"),
                     (F.coalesce(color.cast("string"), F.lit("Unknown")) if color is not None else F.lit("")).alias("color"),
                     value.cast("double").alias("v"))
    if how == "median":
        out = exact_percentiles(base, "v", [0.5], ["bucket", "color"]).select("bucket", "color", F.col("q0").alias("value"))
    else:
        agg = {"sum": F.coalesce(F.sum("v"), F.lit(0.0)), "average": F.avg("v"), "count": F.count("v").cast("double")}[how]
        out = base.groupBy("bucket", "color").agg(agg.alias("value"))
    if top_n:
        keep = out.groupBy("bucket").agg(F.sum("value").alias("s")).orderBy(F.desc("s"), "bucket").limit(top_n)
        out = out.join(F.broadcast(keep.select("bucket")), "bucket", "left_semi")   # at most top_n rows
    return out


def top_groups(df: DataFrame, name: Column, metric: str, limit: int = 10) -> DataFrame:
    return (df.select(T.blank(name).alias("name"), metric).filter("name <> ''").groupBy("name")
            .agg(F.sum(metric).cast("double").alias("value")).orderBy(F.desc("value"), "name").limit(limit))


def part_label() -> Column:
    d = T.blank("part_description")
    return F.when(d == "", T.blank("part_number")).otherwise(F.concat_ws(" - ", T.blank("part_number"), d))


def table_page(df: DataFrame, sort: list[Column], page: int, size: int) -> DataFrame:
    """One page of a totally ordered table."""
    return df.orderBy(*sort).offset((page - 1) * size).limit(size)


# --- joins of sales and vehicle volumes -------------------------------------------------

def monthly_full(sales: DataFrame, wl: DataFrame) -> DataFrame:
    """Monthly sales and vehicles, full outer, without the latest sales month."""
    s = sales.filter("sale_date is not null").groupBy(D.month_of("sale_date").alias("month")).agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").alias("quantity"))
    latest = s.agg(F.max("month").alias("latest"))
    w = wl.groupBy("month").agg(F.sum("wholesale_units").alias("wholesale_units"))
    j = s.join(w, "month", "full_outer").crossJoin(F.broadcast(latest)).filter("month < latest")
    units = F.nullif(F.col("wholesale_units"), F.lit(0.0))
    return j.select("month", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                    F.coalesce("quantity", F.lit(0.0)).alias("quantity"), "wholesale_units",
                    (F.coalesce("revenue", F.lit(0.0)) / units).alias("pnvw"))


def monthly_inner(sales: DataFrame, wl: DataFrame) -> DataFrame:
    """Monthly sales and vehicles, inner; revenue per vehicle is 0 when there are no vehicles."""
    s = sales.filter("sale_date is not null").groupBy(D.month_of("sale_date").alias("month")).agg(
        F.sum("revenue").cast("double").alias("revenue"))
    latest = s.agg(F.max("month").alias("latest"))
    w = wl.groupBy("month").agg(F.sum("wholesale_units").alias("wholesale_units"))
    u = F.col("wholesale_units")
    return (s.join(w, "month").crossJoin(F.broadcast(latest)).filter("month < latest")
            .select("month", "wholesale_units", F.when(u == 0, 0.0).otherwise(F.try_divide("revenue", u)).alias("pnvw")))


def wholesale_for_slice(sales: DataFrame, wl: DataFrame) -> DataFrame:
    """Wholesale rows of the models in a slice; a code stands in only when it names one model."""
    s = sales.select(T.normalize_name("model_name").alias("mk"), F.upper(T.blank("model_code")).alias("ck")).filter("mk <> ''").distinct()
    w = wl.withColumns({"mk": T.normalize_name("model_name"), "ck": F.upper(T.blank("model_code"))})
    by_name = w.join(s.select("mk").distinct(), "mk", "left_semi")
    unmatched = s.join(w.select("mk").distinct(), "mk", "left_anti").select("ck").distinct()
    unique = w.filter("ck <> ''").groupBy("ck").agg(F.min("mk").alias("a"), F.max("mk").alias("z")).filter("a = z").select("ck")
    safe = unmatched.join(unique, "ck", "left_semi")
    by_code = w.join(s.select("mk").distinct(), "mk", "left_anti").join(safe, "ck", "left_semi")
    return by_name.unionByName(by_code).drop("mk", "ck")


def names_of(df: DataFrame, column: str) -> DataFrame:
    return df.select(T.normalize_name(column).alias("value")).filter("value <> ''").distinct()


def match_coverage(sales: DataFrame, wl: DataFrame, column: str) -> DataFrame:
    s, w = names_of(sales, column), names_of(wl, column)
    flags = (s.withColumn("s", F.lit(1)).join(w.withColumn("w", F.lit(1)), "value", "full_outer"))
    return flags.agg(F.count_if(F.col("s").isNotNull() & F.col("w").isNotNull()).alias("matched"),
                     F.count("s").alias("sales_values"), F.count("w").alias("wholesale_values")).withColumn(
        "coverage_pct", F.round(F.col("matched") / F.nullif(F.col("sales_values"), F.lit(0)) * 100, 2))


def unmatched_values(sales: DataFrame, wl: DataFrame, column: str, row_id: str, limit: int = 10, rows: int = 5) -> DataFrame:
    """First unmatched values in name order, each with up to five source rows."""
    s = sales.select(T.normalize_name(column).alias("value"), F.col(row_id).alias("rid")).filter("value <> ''")
    vals = s.select("value").distinct().join(names_of(wl, column), "value", "left_anti").orderBy("value").limit(limit)
    hit = s.join(F.broadcast(vals), "value")                      # at most ``limit`` values
    w = Window.partitionBy("value").orderBy("rid")
    return (hit.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= rows)
            .groupBy("value").agg(F.array_join(F.array_sort(F.collect_list("rid")), ",").alias("rows")))


def ambiguous_codes(df: DataFrame) -> DataFrame:
    p = df.select(F.upper(T.blank("model_code")).alias("code"), T.normalize_name("model_name").alias("model"))
    p = p.filter("code <> '' and model <> ''").distinct()
    return (p.groupBy("code").agg(F.count(F.lit(1)).alias("model_count"), F.array_join(F.array_sort(F.collect_set("model")), " / ").alias("models"))
            .filter("model_count > 1"))


def revenue_wholesale_correlation(monthly: DataFrame) -> DataFrame:
    p = monthly.filter("revenue is not null and wholesale_units is not null")
    ok = (F.count(F.lit(1)) >= 2) & (F.min("revenue") < F.max("revenue")) & (F.min("wholesale_units") < F.max("wholesale_units"))
    return p.agg(F.when(ok, F.round(F.corr("revenue", "wholesale_units"), 3)).alias("correlation"), F.count(F.lit(1)).alias("pairs"))


def source_anchor_rows(sales: DataFrame, facts: DataFrame, letter_anchor=("K", "KUS", "source_brand_kus"),
                       default=("HMA", "hma_default_fallback")) -> DataFrame:
    """Sales rows pre-grouped to source x model x month, with the anchor the facts gave the model."""
    m = facts.groupBy("brand", "model_name").agg(T.mode_text("anchor_brand").alias("a"), T.mode_text("anchor_method").alias("m"))
    g = (sales.filter((T.blank("model_name") != "") & F.col("sale_date").isNotNull())
         .groupBy(F.upper(T.blank("brand")).alias("brand"), T.blank("model_name").alias("model_name"),
                  D.month_of("sale_date").alias("month"), F.col("model_year"))
         .agg(F.sum(T.clip_zero(F.col("quantity"))).alias("quantity"), F.sum("revenue").alias("revenue"),
              F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale")))
    is_k = F.col("brand") == letter_anchor[0]
    return (g.join(m, ["brand", "model_name"], "left")
            .withColumn("anchor_brand", F.coalesce("a", F.when(is_k, letter_anchor[1]).otherwise(default[0])))
            .withColumn("anchor_method", F.coalesce("m", F.when(is_k, letter_anchor[2]).otherwise(default[1]))).drop("a", "m"))


def source_anchor_summary(rows: DataFrame) -> DataFrame:
    latest = rows.agg(F.max("month").alias("latest"))
    return (rows.crossJoin(F.broadcast(latest)).filter("month = latest").groupBy("brand", "anchor_brand")
            .agg(F.sum("quantity").alias("quantity"), F.sum("revenue").cast("double").alias("revenue")))


def source_anchor_models(rows: DataFrame, source: str) -> DataFrame:
    latest = rows.agg(F.max("month").alias("latest"))
    r = rows.crossJoin(F.broadcast(latest)).filter(F.col("brand") == source)
    return r.groupBy("anchor_brand", "model_name", "anchor_method").agg(
        T.join_unique("model_year").alias("model_years"), T.join_unique(F.substring("month", 1, 4)).alias("sales_years"),
        F.min("first_sale").cast("string").alias("first_sale"), F.max("last_sale").cast("string").alias("last_sale"),
        F.coalesce(F.sum(F.when(F.col("month") == F.col("latest"), F.col("quantity"))), F.lit(0.0)).alias("latest_quantity"),
        F.sum("quantity").alias("quantity"), F.sum("revenue").cast("double").alias("revenue"))


def insights(df: DataFrame) -> DataFrame:
    """Date coverage, top model by revenue, top part by quantity, share of rows with a quantity."""
    a = df.agg(F.min("sale_date").cast("string").alias("lo"), F.max("sale_date").cast("string").alias("hi"),
               F.round(F.count_if(F.col("quantity") > 0) / F.count(F.lit(1)) * 100, 4).alias("share"))
    cover = a.select(F.lit("date_coverage").alias("insight"), F.concat_ws(" to ", "lo", "hi").alias("subject"), F.lit(None).cast("double").alias("value"))
    share = a.select(F.lit("rows_with_quantity").alias("insight"), F.lit("").alias("subject"), F.col("share").alias("value"))
    lead = leaders(df).filter("kind in ('model', 'part')").select(
        F.concat(F.lit("top_"), "kind").alias("insight"), F.col("name").alias("subject"), "value")
    return cover.unionByName(share).unionByName(lead)


def date_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.min("sale_date").cast("string").alias("min_date"), F.max("sale_date").cast("string").alias("max_date"),
                  F.count_distinct(D.month_of("sale_date")).alias("active_months"), F.min(F.year("sale_date")).alias("start_year"))
