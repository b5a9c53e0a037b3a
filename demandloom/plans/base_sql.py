"""Named SQL building blocks for the second engine that checks every query.

``sql(body)`` puts the blocks a body mentions in front of it as common table expressions.
"""

from __future__ import annotations

import re

_BLOCKS: dict[str, str] = {}


def block(name: str, body: str) -> None:
    _BLOCKS[name] = body.strip()


def sql(body: str) -> str:
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bb_\w+", text):
            if name in _BLOCKS and name not in need:
                visit(_BLOCKS[name])
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    parts = ",\n".join(f"{n} AS ({_BLOCKS[n]})" for n in need)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


block("b_part", """
SELECT p_partkey, p_name AS model_name, p_brand AS model_code, p_type AS plc,
  CAST(p_partkey AS VARCHAR) AS part_number, p_name || ' ' || p_type AS part_description,
  CASE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'G' ELSE 'K' END AS brand,
  CASE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 3 WHEN 0 THEN 'HMA' WHEN 1 THEN 'GMA' ELSE 'KUS' END AS anchor
FROM part""")
block("b_sales", """
SELECT CAST(l_shipdate AS DATE) AS sale_date, strftime(l_shipdate, '%Y-%m') AS month, brand, model_name, model_code,
  coalesce(CAST(year(o_orderdate) AS VARCHAR), '') AS model_year, part_number, part_description, plc,
  l_quantity AS quantity, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS revenue,
  upper(model_name) AS model_key, brand || '::' || upper(model_name) AS entity_key
FROM lineitem JOIN b_part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey""")
block("b_whrows", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, anchor AS brand, model_name, model_code,
  CASE WHEN l_linestatus = 'F' THEN 'fleet' ELSE 'wholesale' END AS channel,
  CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS units
FROM lineitem JOIN b_part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
block("b_wl", """
SELECT month, brand AS anchor_brand, upper(model_name) AS model_key, min(brand) AS brand, min(model_name) AS model_name,
  string_agg(DISTINCT model_code, ' / ' ORDER BY model_code) AS model_code,
  sum(CASE WHEN channel = 'wholesale' THEN units ELSE 0 END) AS wholesale_units,
  sum(CASE WHEN channel = 'fleet' THEN units ELSE 0 END) AS fleet_units,
  string_agg(DISTINCT CASE WHEN channel = 'fleet' THEN 'Fleet' ELSE 'Dealer / non-fleet' END, ' / '
    ORDER BY CASE WHEN channel = 'fleet' THEN 'Fleet' ELSE 'Dealer / non-fleet' END) AS channel
FROM b_whrows GROUP BY ALL""")
block("b_amvol", """
SELECT model_key, anchor_brand, sum(wholesale_units) AS units, count(*) FILTER (wholesale_units > 0) AS active
FROM b_wl GROUP BY ALL""")
block("b_amexact", """
SELECT model_key, arg_min(anchor_brand, (-units, -active, anchor_brand)) AS anchor_brand,
  max(units) AS units,
  CASE WHEN count(*) FILTER (units > 0) > 0 THEN count(*) FILTER (units > 0) ELSE count(*) END AS ncand,
  CASE WHEN count(*) FILTER (units > 0) > 0 THEN string_agg(anchor_brand, ' / ' ORDER BY anchor_brand) FILTER (units > 0)
       ELSE string_agg(anchor_brand, ' / ' ORDER BY anchor_brand) END AS candidates
FROM b_amvol GROUP BY model_key""")
block("b_amalias", """
SELECT DISTINCT model_key, anchor_brand, units, unnest([
  regexp_replace(regexp_replace(model_key, '\\bPLUG[\\s-]*IN\\s+HYBRID\\b', 'PHEV', 'g'), '\\bHYBRID\\b', 'HEV', 'g'),
  trim(regexp_replace(regexp_replace(regexp_replace(model_key, '\\bPLUG[\\s-]*IN\\s+HYBRID\\b', 'PHEV', 'g'), '\\bHYBRID\\b', 'HEV', 'g'), '\\s+(EV|HEV|PHEV)$', ''))]) AS alias
FROM b_amexact""")
block("b_amap", """
SELECT model_key, anchor_brand, CASE WHEN ncand = 1 THEN 'dealer_wholesale_exact' ELSE 'dealer_wholesale_volume_resolved' END AS method,
  candidates, units FROM b_amexact
UNION ALL
SELECT alias, min(anchor_brand), 'dealer_wholesale_variant_alias', min(anchor_brand), sum(units) FROM b_amalias
WHERE alias <> model_key AND alias <> '' AND alias NOT IN (SELECT model_key FROM b_amexact)
GROUP BY alias HAVING min(anchor_brand) = max(anchor_brand)""")
block("b_cal", """
SELECT strftime(m, '%Y-%m') AS month,
  CAST(list_count(list_filter(range(CAST(m AS TIMESTAMP), CAST(m + INTERVAL 1 MONTH AS TIMESTAMP), INTERVAL 1 DAY), lambda d: isodow(d) <= 5)) AS DOUBLE) AS working_days
FROM (SELECT CAST(unnest(range(TIMESTAMP '1994-01-01', TIMESTAMP '2004-01-01', INTERVAL 1 MONTH)) AS DATE) AS m)""")
block("b_factsraw", """
SELECT s.month, s.brand, coalesce(a.anchor_brand, CASE WHEN s.brand = 'K' THEN 'KUS' ELSE 'HMA' END) AS anchor_brand,
  coalesce(a.method, CASE WHEN s.brand = 'K' THEN 'source_brand_kus' ELSE 'hma_default_fallback' END) AS anchor_method,
  s.entity_key, s.model_key, s.model_name, s.model_year, s.plc, s.part_number,
  string_agg(DISTINCT s.model_code, ' / ' ORDER BY s.model_code) AS model_code, min(s.part_description) AS part_description,
  sum(s.quantity) AS quantity, sum(s.revenue) AS revenue, count(*) AS source_rows
FROM b_sales s LEFT JOIN b_amap a USING (model_key)
WHERE year(s.sale_date) BETWEEN 1995 AND 2001 GROUP BY ALL""")
block("b_facts", """
SELECT f.*, w.wholesale_units, w.fleet_units, c.working_days,
  f.quantity / nullif(w.wholesale_units, 0) AS units_per_vehicle,
  CAST(f.revenue AS DOUBLE) / nullif(w.wholesale_units, 0) AS pnvw,
  f.quantity / nullif(c.working_days, 0) AS qty_per_working_day
FROM b_factsraw f LEFT JOIN b_wl w ON f.month = w.month AND f.anchor_brand = w.anchor_brand AND f.model_key = w.model_key
LEFT JOIN b_cal c ON f.month = c.month""")
block("b_pmonth", """
SELECT part_number, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o, sum(quantity) AS q
FROM (SELECT *, max(sale_date) OVER (PARTITION BY part_number) AS last FROM b_sales)
WHERE NOT (last < last_day(last) AND day(last) <= 27 AND month = strftime(last, '%Y-%m')) GROUP BY ALL""")
block("b_pdense", """
SELECT r.part_number, r.o, printf('%04d-%02d', r.o // 12, r.o % 12 + 1) AS month, coalesce(m.q, 0) AS value
FROM (SELECT part_number, unnest(range(min(o), max(o) + 1)) AS o FROM b_pmonth GROUP BY part_number) r
LEFT JOIN b_pmonth m ON r.part_number = m.part_number AND r.o = m.o""")
block("b_pser", "SELECT part_number, CAST(min(o) AS INT) AS start_ord, list(value ORDER BY o) AS h, CAST(count(*) AS INT) AS n FROM b_pdense GROUP BY part_number")
block("b_amonth", """
SELECT anchor_brand AS entity, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS o,
  sum(quantity) AS q, CAST(sum(revenue) AS DOUBLE) AS r FROM b_factsraw WHERE month <= '2001-10' GROUP BY ALL""")
block("b_aser", """
SELECT e.entity, CAST(min(e.o) AS INT) AS start_ord, list(coalesce(m.q, 0) ORDER BY e.o) AS h, list(coalesce(m.r, 0) ORDER BY e.o) AS hr, CAST(count(*) AS INT) AS n
FROM (SELECT entity, unnest(range(min(o), 2001 * 12 + 9 + 1)) AS o FROM b_amonth GROUP BY entity) e
LEFT JOIN b_amonth m ON e.entity = m.entity AND e.o = m.o GROUP BY e.entity""")
