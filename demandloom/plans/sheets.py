"""Queries: raw cells, headers, typing, unpivot."""

from pyspark.sql import functions as F

from ..config import DATE_HINTS, ROLE_PATTERNS
from ..functions import dates as D
from ..functions import text as T
from ..operators import facts as FA
from ..session import materialize
from ..sources import planning as P
from ..sources import roles as RO
from ..sources import sheets as SH
from .base_sql import block
from .registry import query

ROW = 1_000_000_000


def cells(spark, path):
    """Vehicle volumes laid out as planning sheets: two years per sheet, sparse brands, channel markers, totals."""
    w = P.wholesale_rows(spark, path)
    year, mm = F.substring("month", 1, 4).cast("int"), F.substring("month", 6, 2).cast("int")
    first = year - (year - 1) % 2
    code = F.regexp_extract("model_code", r"(\d+)", 1).cast("long")
    b = F.when(F.col("brand") == "GMA", 1).when(F.col("brand") == "HMA", 2).otherwise(3)
    keys = P.table(spark, path, "part", "p_partkey", "p_name", "p_brand").groupBy(F.col("p_name").alias("model_name"), F.col("p_brand").alias("model_code")).agg(F.min("p_partkey").alias("pk"))
    w = w.join(keys, ["model_name", "model_code"]).select(
        F.concat(F.lit("wholesale "), first.cast("string")).alias("sheet"),
        ((F.when(F.col("channel") == "fleet", 4).otherwise(0) + b).cast("long") * F.lit(100 * ROW) + code * F.lit(ROW) + F.col("pk")).alias("r"),
        ((year - first) * 12 + mm + 2).cast("int").alias("c"), "brand", "model_name", "model_code", "channel", "units")
    w = w.withColumn("units", F.when(F.col("units") == 7, -1.0).otherwise(F.col("units")))       # the source's mark for "none"
    rows = w.groupBy("sheet", "r", "brand", "model_name", "model_code", "channel").agg(F.count(F.lit(1)).alias("n"))
    top = rows.groupBy("sheet", "channel", "brand").agg(F.min("r").alias("r")).select("sheet", "r", F.lit(0).alias("c"), F.col("brand").alias("v"))
    tot = w.groupBy("sheet", "brand", "channel", "c").agg(F.sum(F.greatest("units", F.lit(0.0))).alias("u"), (F.max("r") + 1).alias("rr"))
    last = rows.groupBy("sheet", "brand", "channel").agg((F.max("r") + 1).alias("r"))
    total = tot.join(last, ["sheet", "brand", "channel"])
    sheets = rows.select("sheet").distinct()
    labels = ["Brand", "Model", "Model Code"] + [m for _ in range(2) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]
    header = sheets.select("sheet", F.lit(-1).cast("long").alias("r"), F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("c", "v"))
    cell = lambda d, r, c, v: d.select("sheet", r.cast("long").alias("r"), c.cast("int").alias("c"), v.cast("string").alias("v"))
    parts = [cell(header, F.col("r"), F.col("c"), F.col("v")), cell(sheets, F.lit(-2), F.lit(0), F.lit("Vehicle volumes")),
             cell(sheets, F.lit(0), F.lit(0), F.lit("Wholesale")), cell(sheets, F.lit(4 * 100 * ROW), F.lit(0), F.lit("Fleet")), cell(top, F.col("r"), F.col("c"), F.col("v")),
             cell(rows, F.col("r"), F.lit(1), F.col("model_name")), cell(rows, F.col("r"), F.lit(2), F.col("model_code")), cell(w, F.col("r"), F.col("c"), F.col("units")),
             cell(last, F.col("r"), F.lit(1), F.lit("Total")), cell(total, F.col("r"), F.col("c"), F.col("u"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out)


def sheet_data(spark, path):
    c = cells(spark, path)
    return SH.data_cells(c, SH.header_plan(c))


block("b_sh", "SELECT *, CAST(month[1:4] AS INT) - (CAST(month[1:4] AS INT) - 1) % 2 AS first, CASE WHEN units = 7 THEN 0 ELSE units END AS u FROM b_whrows")


@query("S1_S2_S3_header_plan", """WITH m AS (SELECT DISTINCT first, CAST(month[1:4] AS INT) AS y, CAST(month[6:7] AS INT) AS mm FROM b_sh),
x AS (SELECT DISTINCT first, CAST(i - 1 AS INT) AS c, ['Brand','Model','Model Code'][i] AS name FROM m, range(1, 4) t(i)
 UNION ALL SELECT first, CAST((y - first) * 12 + mm + 2 AS INT), ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][mm] || CASE WHEN y > first THEN ' (2)' ELSE '' END FROM m)
SELECT 'wholesale ' || first AS sheet, 0 AS header_row, 2 AS header_depth, c, name FROM x""")
def s2(spark, path):
    return SH.header_plan(cells(spark, path)).select("sheet", "header_row", "header_depth", "c", "name")


@query("S4_F9_column_types", """SELECT 'wholesale ' || first AS sheet, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][CAST(month[6:7] AS INT)] || CASE WHEN CAST(month[1:4] AS INT) > first THEN ' (2)' ELSE '' END AS name,
 sum(u) AS total FROM b_sh GROUP BY ALL""")
def s4(spark, path):
    d = sheet_data(spark, path)
    models = d.filter("name = 'Model' and v <> 'Total'").select("sheet", "r")
    num = SH.typed_cells(d, SH.column_types(d).withColumn("type", F.when(T.month_number_of(F.col("name")).isNotNull(), "numeric").otherwise(F.col("type"))))
    return num.filter("number is not null").join(models, ["sheet", "r"], "left_semi").groupBy("sheet", "name").agg(F.sum("number").alias("total"))


def date_sql(c: str, kind: str) -> str:
    """A cell as a date: what functions.dates.mixed_date reads."""
    if kind == "date":
        return f"CAST({c} AS DATE)"
    n = f"TRY_CAST({c} AS DOUBLE)" if kind == "numeric" else f"TRY_CAST(trim({c}) AS DOUBLE)"
    day = lambda text: f"CAST(try_strptime({text}, '%Y%m%d') AS DATE)"
    i = f"CAST({n} AS BIGINT)"
    number = (f"CASE WHEN abs({n} % 1) >= 1e-9 THEN NULL WHEN {n} BETWEEN 19000101 AND 21001231 THEN {day(f'{i}::VARCHAR')} WHEN {n} BETWEEN 190001 AND 210012 THEN {day(f"{i}::VARCHAR || '01'")} "
              f"WHEN {n} BETWEEN 1900 AND 2100 THEN {day(f"{i}::VARCHAR || '0101'")} WHEN {n} BETWEEN 20000 AND 80000 THEN DATE '1899-12-30' + {i}::INT END")
    if kind == "numeric":
        return number
    written = f"try_strptime(trim({c}), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%Y-%m', '%m/%d/%Y', '%d %b %Y', '%b %d, %Y', '%b %Y'])"
    return f"CASE WHEN {n} IS NOT NULL THEN {number} WHEN year({written}) BETWEEN 1900 AND 2100 THEN CAST({written} AS DATE) END"


def facts_sql(tables: dict[str, list[tuple[str, str]]]) -> str:
    """Column facts of tables: {source: [(column, kind)]}; a source may name a block."""
    hint = "(" + " OR ".join(f"list_contains(string_split(token, ' '), '{h}') OR token LIKE '%{h}%'" for h in DATE_HINTS) + ")"
    rows = []
    for source, columns in tables.items():
        for i, (c, kind) in enumerate(columns):
            d = date_sql(f'"{c}"', kind)
            rows.append(f"""SELECT '{source}' AS source, {i} AS place, '{c}' AS "column", '{kind}' AS kind, count(*) AS rows, count(d) AS dates, coalesce(min(d) < max(d), false) AS differ,
 count(DISTINCT year(d) * 12 + month(d)) > 2 OR count(DISTINCT day(d)) > 1 AS spread FROM (SELECT {d} AS d FROM {BLOCK_OF.get(source, source)})""")
    return f"""SELECT *, dates >= {RO.DATE_SHARE} * rows AND differ AND ({hint} OR spread) AS date_candidate FROM (SELECT *, trim(regexp_replace(regexp_replace(lower("column"), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS token FROM ({" UNION ALL ".join(rows)}))"""


BLOCK_OF = {"sales": "b_sales", "wholesale": "b_whrows"}
CATALOG = {
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"), ("o_orderdate", "date"), ("o_orderpriority", "text")],
    "lineitem": [(c, "numeric") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "date")],
    "part": [("p_partkey", "numeric"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "sales": [("sale_date", "date"), ("brand", "text"), ("model_name", "text"), ("model_code", "text"), ("model_year", "text"), ("part_number", "text"), ("part_description", "text"),
              ("plc", "text"), ("quantity", "numeric"), ("revenue", "numeric")],
    "wholesale": [("month", "text"), ("brand", "text"), ("model_name", "text"), ("model_code", "text"), ("channel", "text"), ("units", "numeric")],
}


def catalog(spark, path):
    """The given tables and the two planning tables made of them, each with the columns it has in the catalog."""
    given = {s: P.table(spark, path, s, *[c for c, _ in CATALOG[s]]) for s in ("orders", "lineitem", "part")}
    return given | {"sales": P.sales(spark, path, model_year=True), "wholesale": P.wholesale_rows(spark, path)}


block("b_colfacts", facts_sql(CATALOG))
block("b_rolescore", """SELECT source, role, place, "column", kind, date_candidate, name_score + CASE WHEN role = 'date' AND date_candidate AND kind = 'date' THEN 4 WHEN role = 'date' AND date_candidate THEN 2
  WHEN role IN ('installation_quantity', 'revenue') AND name_score > 0 AND kind = 'numeric' THEN 1 ELSE 0 END AS score
 FROM (SELECT source, role, place, "column", kind, date_candidate, sum(CASE WHEN token = pattern THEN 4 WHEN ends_with(token, pattern) THEN 2 WHEN contains(token, pattern) THEN 1 ELSE 0 END) AS name_score
  FROM b_colfacts, (VALUES """ + ", ".join(f"('{r}', '{p}')" for r, ps in ROLE_PATTERNS.items() for p in ps) + """) t(role, pattern) GROUP BY ALL)""")
block("b_roles", """SELECT source, role, "column", score, date_candidate FROM (SELECT *, row_number() OVER (PARTITION BY source, role ORDER BY score DESC, place) AS k FROM b_rolescore WHERE score > 0) WHERE k = 1
UNION ALL SELECT source, 'date', arg_min("column", place), 0, true FROM b_colfacts WHERE date_candidate AND source NOT IN (SELECT source FROM b_rolescore WHERE role = 'date' AND score > 0) GROUP BY source""")


@query("S5_column_facts", 'SELECT source, place, "column", kind, rows, dates, date_candidate FROM b_colfacts')
def s5f(spark, path):
    return RO.column_facts(catalog(spark, path))


@query("S5_roles", 'SELECT source, role, "column", CAST(score AS INT) AS score, date_candidate FROM b_roles')
def s5r(spark, path):
    return RO.roles(RO.column_facts(catalog(spark, path)))


@query("S6_choose_source", """WITH w AS (SELECT * FROM (VALUES (0, 'orders'), (1, 'lineitem'), (2, 'part'), (3, 'sales'), (4, 'wholesale')) s(place, source), (VALUES (0, 'date'), (1, 'model'), (2, 'installation_quantity'), (3, 'revenue')) r(n, role)),
h AS (SELECT place, w.source, count(b.role) AS held, coalesce(string_agg(CASE WHEN b.role IS NULL THEN w.role END, ',' ORDER BY n), '') AS missing FROM w
 LEFT JOIN b_roles b ON b.source = w.source AND b.role = w.role AND (b.role <> 'date' OR b.date_candidate) GROUP BY ALL)
SELECT CAST(place AS INT) AS place, source, CAST(held AS INT) AS held, missing, missing = '' AS complete,
 source = (SELECT source FROM h WHERE missing = '' ORDER BY source <> 'orders', place LIMIT 1) AS chosen, contains(source, 'wholesale') AS is_wholesale FROM h""")
def s6c(spark, path):
    tables = catalog(spark, path)
    found = materialize(RO.roles(RO.column_facts(tables)))
    names = list(tables)
    chosen, volumes = RO.choose(found, names, requested="orders", canonical="sales_data"), RO.named(names, "wholesale")
    return RO.holding(found, names).withColumns({"chosen": F.col("source") == chosen, "is_wholesale": F.col("source").isin(*volumes)})


@query("S5_S6_trend_by_inferred_roles", "SELECT month, sum(quantity) AS quantity FROM b_sales GROUP BY month")
def s56(spark, path):
    tables = {s: df for s, df in catalog(spark, path).items() if s in ("part", "sales")}
    found = materialize(RO.roles(RO.column_facts(tables)))
    source = RO.choose(found, list(tables))
    r = RO.as_roles(found, source)
    return tables[source].groupBy(D.month_of(r.date).alias("month")).agg(F.sum(r.quantity).alias("quantity"))


@query("S5_role_types", f"""SELECT 'orders' AS sheet, name, CASE WHEN date_share >= 0.75 AND name LIKE '%date%' THEN 'date' WHEN number_share >= 0.95 THEN 'numeric' ELSE 'text' END AS type, round(date_share, 6) AS date_share, round(number_share, 6) AS number_share FROM (
SELECT name, count(d) / count(*)::DOUBLE AS date_share, count(TRY_CAST(v AS DOUBLE)) / count(*)::DOUBLE AS number_share FROM (SELECT name, v, {date_sql('v', 'text')} AS d FROM (
SELECT 'order date' AS name, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders UNION ALL SELECT 'item number', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders)) GROUP BY name)""")
def s5(spark, path):
    o = P.table(spark, path, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    e = F.array(F.struct(F.lit("order date").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("v")),
                F.struct(F.lit("item number").alias("name"), F.col("o_orderkey").cast("string").alias("v")), F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("v")))
    d = o.select(F.lit("orders").alias("sheet"), F.col("o_orderkey").alias("r"), F.explode(e).alias("x")).select("sheet", "r", "x.*")
    return SH.column_types(d).select("sheet", "name", "type", F.round("date_share", 6).alias("date_share"), F.round("number_share", 6).alias("number_share"))


@query("R1_W8_unpivot_facts", """SELECT month, brand AS anchor_brand, upper(model_name) AS model_key, string_agg(DISTINCT model_code, ' / ' ORDER BY model_code) AS model_code,
 coalesce(sum(u) FILTER (channel = 'wholesale'), 0) AS wholesale_units, coalesce(sum(u) FILTER (channel = 'fleet'), 0) AS fleet_units, 'wholesale ' || first AS source_sheet FROM b_sh GROUP BY ALL""")
def r1(spark, path):
    return FA.wholesale_long(SH.unpivot_months(sheet_data(spark, path))).select(
        "month", "anchor_brand", "model_key", "model_code", "wholesale_units", "fleet_units", "source_sheet")


@query("R2_W8_unpivot_pivot_variant", """SELECT month, brand, model_name AS model, channel, sum(CASE WHEN units = 7 THEN -1 ELSE units END) AS units FROM b_sh GROUP BY ALL
UNION ALL SELECT month, brand, 'Total', channel, sum(u) FROM b_sh GROUP BY ALL""")
def r2(spark, path):
    u = SH.unpivot_months(sheet_data(spark, path), drop_totals=False, clip=False, toggling=False)
    u = u.withColumn("brand", F.col("brand"))
    return u.groupBy("month", "brand", F.col("model_name").alias("model"), "channel").agg(F.sum("units").alias("units"))


@query("R7_nested_to_long", "SELECT month, anchor_brand, k, v FROM (UNPIVOT (SELECT month, anchor_brand, sum(wholesale_units) AS dealer, sum(fleet_units) AS fleet FROM b_wl GROUP BY ALL) ON dealer, fleet INTO NAME k VALUE v)")
def r7(spark, path):
    w = FA.wholesale_long(P.wholesale_rows(spark, path)).groupBy("month", "anchor_brand").agg(
        F.array(F.struct(F.lit("dealer").alias("k"), F.sum("wholesale_units").alias("v")), F.struct(F.lit("fleet").alias("k"), F.sum("fleet_units").alias("v"))).alias("rec"))
    return w.select("month", "anchor_brand", F.explode("rec").alias("x")).select("month", "anchor_brand", "x.*")


@query("F6_mixed_dates", """SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 2 THEN date_trunc('month', o_orderdate) WHEN 3 THEN date_trunc('year', o_orderdate) WHEN 6 THEN NULL ELSE o_orderdate END AS DATE)::VARCHAR AS d FROM orders""")
def f6(spark, path):
    o = P.table(spark, path, "orders", "o_orderkey", "o_orderdate")
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    txt = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "yyyyMM")).when(k == 3, F.date_format(d, "yyyy"))
           .when(k == 4, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")).when(k == 5, F.date_format(d, "yyyy/MM/dd")).otherwise("0001-01-01"))
    return o.select("o_orderkey", D.mixed_date(txt).cast("string").alias("d"))


@query("F5_F12_year_and_month_labels", """SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y1, CASE WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '' END AS y2, CAST(month(o_orderdate) AS INT) AS m, CAST(1 + o_orderkey % 3 AS INT) AS b FROM orders""")
def f5(spark, path):
    o = P.table(spark, path, "orders", "o_orderkey", "o_orderdate")
    y = F.date_format("o_orderdate", "yyyy")
    suffix = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(" ("), (1 + F.col("o_orderkey") % 3).cast("string"), F.lit(")")))
    label = F.concat(F.date_format("o_orderdate", "MMM"), suffix)
    return o.select("o_orderkey", T.model_year(F.concat(y, F.lit(".0"))).alias("y1"), T.model_year(F.concat(F.lit("MY "), y, F.lit(" x"))).alias("y2"),
                    T.month_number_of(label).alias("m"), T.block_number_of(label).alias("b"))


@query("F7_F8_tokens_and_hints", """SELECT DISTINCT lower(p_name) || ' total 7' AS token, false AS date_hint, true AS number_hint FROM part""")
def f7(spark, path):
    raw = F.concat(F.replace(F.upper("p_name"), F.lit(" "), F.lit("__-|")), F.lit("  (Total) #7"))
    return P.table(spark, path, "part", "p_name").select(T.token_string(raw).alias("token"), T.has_date_hint(raw).alias("date_hint"), T.has_numeric_hint(raw).alias("number_hint")).distinct()


@query("F17_lifecycle_codes", """SELECT CASE o_orderstatus WHEN 'F' THEN 'discontinued' WHEN 'O' THEN 'new' ELSE 'unknown' END AS code, count(*) AS n FROM orders GROUP BY 1""")
def f17(spark, path):
    o = P.table(spark, path, "orders", "o_orderstatus")
    lab = F.when(F.col("o_orderstatus") == "F", "Discontinued through 2000").when(F.col("o_orderstatus") == "O", " New / limited history").otherwise("?")
    return o.groupBy(T.lifecycle_code(lab).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("F1_F2_keys", """SELECT DISTINCT brand, model_name, upper(model_name) AS model_key, brand || '::' || upper(model_name) AS entity_key, 'UNKNOWN::' || upper(model_name) AS no_brand FROM b_part""")
def f1(spark, path):
    p = P._parts(spark, path)
    messy = F.concat(F.lit("  "), F.replace("model_name", F.lit(" "), F.lit("   ")), F.lit(" "))
    return p.select("brand", "model_name", T.normalize_name(messy).alias("model_key"), T.entity_key(messy, F.lower("brand")).alias("entity_key"),
                    T.entity_key(messy, F.lit(None)).alias("no_brand")).distinct()
