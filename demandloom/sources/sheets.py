"""Raw sheets as a long cells table: cells(sheet STRING, r BIGINT, c INT, v STRING)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUSINESS_HEADER_SIGNALS, HEADER_WEIGHTS, HEADERISH_TOKENS, MONTH_NUMBERS, PREFIX_SHARE
from ..functions import dates as D
from ..functions import text as T
from ..session import materialize

HEADER_TOPS, HEADER_DEPTHS = 8, 3
HEAD_ROWS = HEADER_TOPS + HEADER_DEPTHS + 10          # ten rows below the lowest header


def filled(cells: DataFrame) -> DataFrame:
    """Empty cells drop out; empty rows and columns vanish with them."""
    return cells.withColumn("v", T.clean_cell(F.col("v"))).filter("v is not null")


def forward_fill(df: DataFrame, part: list[str], order: str, value: str, out: str) -> DataFrame:
    """Last non-null value above each row, as a prefix scan in two levels.

    Rows are range-partitioned by (part, order), so a task holds about the same number of rows however long a sheet is and however
    its row numbers lie. Each task's last value of each sheet it holds is carried to the tasks that follow: the scan over tasks has one
    row for a task and a sheet in it, and sees no row of the sheet. Rows of one (part, order) see each other's values in no
    set order; a sheet has one row there.
    """
    d = materialize(df.repartitionByRange(*part, order).sortWithinPartitions(*part, order).withColumn("__p", F.spark_partition_id()))
    last = d.filter(F.col(value).isNotNull()).groupBy(*part, "__p").agg(F.max_by(value, order).alias("__last"))
    # a sheet's tasks in their order; only the first of a sheet's rows in a task can need what came before
    scan = Window.partitionBy(*part).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    held = d.select(*part, "__p").distinct().join(last, [*part, "__p"], "left")
    carry = held.withColumn("__carry", F.last_value("__last", True).over(scan)).filter("__carry is not null").select(*part, "__p", "__carry")
    inner = Window.partitionBy("__p", *part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = d.withColumn("__own", F.last_value(value, True).over(inner))
    return own.join(carry, [*part, "__p"], "left").withColumn(out, F.coalesce("__own", "__carry")).drop("__p", "__own", "__carry")


def head(cells: DataFrame, rows: int = HEAD_ROWS) -> DataFrame:
    """Cells of the first non-empty rows of each sheet, with their position ``k`` (0-based)."""
    w = Window.partitionBy("sheet").orderBy("r")
    pos = (filled(cells).select("sheet", "r").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= rows)
           .withColumn("k", F.col("k") - 1))
    ends = filled(cells).groupBy("sheet", "c").agg(F.max("r").alias("col_end"))     # one row per column
    return filled(cells).join(pos, ["sheet", "r"]).join(ends, ["sheet", "c"])   # at most ``rows`` per sheet


def _grid(cells: DataFrame) -> DataFrame:
    """The head of each sheet with its gaps: (sheet, k, r, c, col_end, v, filled), ``filled`` being the last value at or left of c."""
    h = head(cells)
    rows, cols = h.groupBy("sheet", "k").agg(F.min("r").alias("r")), h.groupBy("sheet", "c").agg(F.min("col_end").alias("col_end"))
    g = rows.join(cols, "sheet").join(h.select("sheet", "k", "c", "v"), ["sheet", "k", "c"], "left")
    return g.withColumn("filled", F.last_value("v", F.lit(True)).over(Window.partitionBy("sheet", "k").orderBy("c")))


def _candidate_names(grid: DataFrame) -> DataFrame:
    """Names of the columns of each sheet under each candidate header (top, depth), and counts of what lies below.

    A candidate leaves a row below it; columns that end inside the header are not part of it.
    """
    cand, by_col = ["sheet", "top", "depth"], ["sheet", "top", "depth", "c"]
    pairs = F.array(*[F.struct(F.lit(t).alias("top"), F.lit(d).alias("depth")) for t in range(HEADER_TOPS) for d in range(1, HEADER_DEPTHS + 1)])
    g = grid.withColumn("rows", F.max("k").over(Window.partitionBy("sheet")) + 1).withColumn("x", F.explode(pairs)).select("*", "x.top", "x.depth")
    g = g.withColumn("below", F.col("k") - F.col("top") - F.col("depth")).filter("top + depth < rows and k >= top and below < 10")
    text = F.trim(F.regexp_replace(F.when(F.col("depth") > 1, F.col("filled")).otherwise(F.col("v")), r"\s+", " "))
    label = F.when((F.col("below") < 0) & ~text.startswith("Unnamed"), F.struct("k", text.alias("label")))
    here, first5 = F.col("v").isNotNull(), F.col("v").isNotNull() & F.col("below").between(0, 4)
    per = g.groupBy(*by_col).agg(
        F.transform(F.array_sort(F.collect_list(label)), lambda x: x["label"]).alias("labels"), F.max(F.when(F.col("below") == -1, F.col("r"))).alias("last_header_r"),
        F.max("col_end").alias("col_end"), F.count_if(F.col("below") >= 0).alias("body_rows"), F.count_if(here & (F.col("below") >= 0)).alias("body_cells"), F.count_if(first5).alias("early_cells"),
        F.count_if(first5 & F.col("v").try_cast("double").isNotNull()).alias("early_numbers"), F.max((F.col("below") == 0) & F.lower(F.trim("v")).isin(*HEADERISH_TOKENS)).alias("headerish"))
    per = per.filter("col_end > last_header_r").withColumn("place", F.row_number().over(Window.partitionBy(*cand).orderBy("c")))
    parts = F.filter("labels", lambda x, i: (i == 0) | (x != F.get("labels", i - 1)))
    per = per.withColumn("parts", parts).withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array(F.concat(F.lit("Unnamed "), "place"))))
    whole = F.split(F.array_join("parts", " | "), r" \| ")                 # a label may hold the separator itself
    per = per.select("*", F.get(whole, 0).alias("lead"), F.get(whole, 1).alias("second"), F.array_join(F.slice(whole, 2, HEAD_ROWS * 100), " | ").alias("rest"))
    # a leading label that all columns share, or nearly all, says nothing about a column
    all_, same = Window.partitionBy(*cand), Window.partitionBy(*cand, "lead")
    alone = (F.min("lead").over(all_) == F.max("lead").over(all_)) & (F.min(F.coalesce("second", F.lit(""))).over(all_) < F.max(F.coalesce("second", F.lit(""))).over(all_))
    major = F.count("second").over(same) >= PREFIX_SHARE * F.count(F.lit(1)).over(all_)
    name = F.when(F.col("second").isNotNull() & (alone | major), F.btrim("rest", F.lit(" |"))).otherwise(F.array_join("parts", " | "))
    per = per.withColumn("name", name).filter(~F.lower("name").rlike(r"^unnamed( \d+)?$"))
    again = F.row_number().over(Window.partitionBy(*cand, "name").orderBy("c"))
    return per.withColumn("name", F.when(again == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), again, F.lit(")"))))


def header_plan(cells: DataFrame) -> DataFrame:
    """(sheet, header_row, header_depth, last_header_r, c, name): where the header is and what it says.

    Three known business names in the first row make it the header; else the first row with six month names is the
    second of two; else the best score wins (ties: the upper, then the shallower header). Everything is an aggregate
    over the first rows of all sheets at once. A sheet without a row below its header has no plan.
    """
    grid = materialize(_grid(cells))                                      # at most HEAD_ROWS rows a sheet
    names = _candidate_names(grid)
    top = grid.filter(F.col("k") < HEADER_TOPS)
    months = F.count_distinct(F.when(F.lower(F.trim("v")).isin(*MONTH_NUMBERS), F.lower(F.trim("v"))))
    known = F.count_distinct(F.when((F.col("k") == 0) & T.token_string("v").isin(*BUSINESS_HEADER_SIGNALS), T.token_string("v")))
    quick = top.groupBy("sheet", "k").agg(months.alias("months"), known.alias("known")).groupBy("sheet").agg(
        F.max("known").alias("known"), F.min(F.when(F.col("months") >= 6, F.col("k"))).alias("at"))
    plain = F.regexp_replace(F.lower("name"), " ", "")
    n, mean = F.count(F.lit(1)), lambda x: F.sum(x) / F.count(F.lit(1))
    named, numeric = ~F.lower("name").startswith("unnamed"), plain.rlike(r"^[0-9:/\-.]+$") | (plain.startswith("20") & (F.length(plain) <= 10))
    w = HEADER_WEIGHTS
    score = (w["named"] * mean(named.cast("int")) + w["distinct"] * F.count_distinct("name") / n + w["filled"] * F.sum("body_cells") / F.sum("body_rows")
             + w["numbers"] * F.coalesce(F.try_divide(F.sum("early_numbers"), F.sum("early_cells")), F.lit(0.0)) - w["headerish"] * mean(F.coalesce("headerish", F.lit(False)).cast("int"))
             - w["numeric_name"] * mean(numeric.cast("int")) - w["step"] * (F.col("top") + F.abs(F.col("depth") - 1)))
    scored = names.groupBy("sheet", "top", "depth").agg(F.round(score, 9).alias("score"))
    best = scored.groupBy("sheet").agg(F.max_by(F.struct("top", "depth"), F.struct("score", -F.col("top"), -F.col("depth"))).alias("best"))
    pair = lambda t, d: F.struct(t.cast("int").alias("top"), F.lit(d).alias("depth"))
    choice = best.join(quick, "sheet").select("sheet", F.when(F.col("known") >= 3, pair(F.lit(0), 1)).when(
        F.col("at").isNotNull(), pair(F.greatest(F.col("at") - 1, F.lit(0)), 2)).otherwise(F.col("best")).alias("b")).select("sheet", "b.top", "b.depth")
    return names.join(choice, ["sheet", "top", "depth"]).select(
        "sheet", F.col("top").alias("header_row"), F.col("depth").alias("header_depth"), "last_header_r", "c", "name")


def data_cells(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """(sheet, r, name, v) below the header. The plan has one row per column of a sheet."""
    return (filled(cells).join(plan.select("sheet", "c", "name", "last_header_r"), ["sheet", "c"])
            .filter("r > last_header_r").select("sheet", "r", "c", "name", "v"))


def column_types(data: DataFrame) -> DataFrame:
    """date / numeric / text per column from the share of cells that parse (blank cells count as not parsed)."""
    rows = data.groupBy("sheet").agg(F.count_distinct("r").alias("rows"))
    s = data.groupBy("sheet", "name").agg(F.count_if(D.mixed_date(F.col("v")).isNotNull()).alias("dates"),
                                          F.count_if(F.col("v").try_cast("double").isNotNull()).alias("numbers"), F.count(F.lit(1)).alias("cells"))
    s = s.join(rows, "sheet")                       # one row per sheet
    d, n = F.col("dates") / F.col("rows"), F.col("numbers") / F.col("rows")
    kind = (F.when((d >= 0.75) & T.has_date_hint(F.col("name")), "date").when((n >= 0.95) | ((n >= 0.5) & T.has_numeric_hint(F.col("name"))), "numeric").otherwise("text"))
    return s.select("sheet", "name", kind.alias("type"), "cells", d.alias("date_share"), n.alias("number_share"))


def typed_cells(data: DataFrame, types: DataFrame) -> DataFrame:
    """Text, number (-1 means none, shown as 0) and date value per cell."""
    j = data.join(types.select("sheet", "name", "type"), ["sheet", "name"])
    num = F.when(F.col("type") == "numeric", T.sentinel_to_zero(F.col("v").try_cast("double")))
    return j.select("sheet", "r", "name", "type", F.when(F.col("type") == "text", F.col("v")).alias("text"), num.alias("number"),
                    F.when(F.col("type") == "date", D.mixed_date(F.col("v"))).alias("date"))


def is_wide_matrix(columns: list[str], roles: dict[str, str]) -> bool:
    import re
    pat = re.compile(r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?:\s*\((\d+)\))?$")      # a fixed value
    return "date" not in roles and any(pat.match(c.strip()) for c in columns)


def start_year(latest_sales_year: int | None) -> Column:
    """First year of a sheet: named in the sheet, else counted back from the latest sales year."""
    named = F.nullif(F.regexp_extract("sheet", r"(20\d{2}|19\d{2})", 1), F.lit("")).cast("int")
    return F.coalesce(named, F.lit(latest_sales_year) - F.col("blocks") + 1)


def unpivot_months(data: DataFrame, *, drop_totals: bool = True, clip: bool = True, toggling: bool = True,
                   latest_sales_year: int | None = None) -> DataFrame:
    """Wide month matrix -> (month, brand, model_name, model_code, channel, units, source_sheet).

    Facts variant: total rows drop out, negatives become 0, markers toggle the channel.
    Pivot variant (all flags False): totals and negatives stay, everything from the first fleet marker on is fleet.
    """
    low = F.lower(F.trim("name"))
    attr = lambda n: F.max(F.when(low == n, F.trim("v")))
    rows = data.groupBy("sheet", "r").agg(attr("brand").alias("raw_brand"), attr("model").alias("model_name"), attr("model code").alias("model_code"))
    rb = F.lower(F.coalesce("raw_brand", F.lit("")))
    marker = F.when(F.contains(rb, F.lit("fleet")), "fleet").when(F.contains(rb, F.lit("wholesale")), "wholesale")
    usable = F.when(F.col("raw_brand").isNotNull() & ~T.is_total(F.col("raw_brand")) & (marker.isNull() | F.lit(not toggling)), F.col("raw_brand"))
    rows = rows.withColumn("marker", marker).withColumn("own", usable)
    rows = forward_fill(rows, ["sheet"], "r", "own", "brand")
    if toggling:
        rows = forward_fill(rows, ["sheet"], "r", "marker", "channel").withColumn("channel", F.coalesce("channel", F.lit("wholesale"))).filter("marker is null")
    else:
        first = rows.filter("marker = 'fleet'").groupBy("sheet").agg(F.min("r").alias("fleet_from"))
        rows = rows.join(first, "sheet", "left").withColumn(          # one row per sheet
            "channel", F.when(F.col("r") >= F.col("fleet_from"), "fleet").otherwise("wholesale"))
    rows = rows.filter("model_name is not null")
    if drop_totals:
        rows = rows.filter(~T.is_total(F.col("model_name")) & ~T.is_total(F.coalesce("raw_brand", F.lit(""))))
    m = data.withColumn("mm", T.month_number_of(F.col("name"))).filter("mm is not null").withColumn("block", T.block_number_of(F.col("name")))
    blocks = m.groupBy("sheet").agg(F.max("block").alias("blocks"))
    m = m.join(blocks, "sheet").withColumn("year", start_year(latest_sales_year) + F.col("block") - 1)   # one row per sheet
    units = T.sentinel_to_zero(F.col("v").try_cast("double")) if clip else F.col("v").try_cast("double")
    m = m.select("sheet", "r", F.format_string("%04d-%02d", "year", "mm").alias("month"), (T.clip_zero(units) if clip else units).alias("units")).filter("units is not null")
    return m.join(rows, ["sheet", "r"]).select("month", F.coalesce("brand", F.lit("")).alias("brand"), "model_name", F.coalesce("model_code", F.lit("")).alias("model_code"),
                                               "channel", "units", F.col("sheet").alias("source_sheet"))
