"""SQL twins of the proxies: common table expressions for the oracle, written on their own."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def sql(needs: tuple[str, ...] | list[str], body: str) -> str:
    """WITH clause holding the named CTEs and what they need, then the body."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


cte("f_area", (), """SELECT n_nationkey AS area_no, substr('ADRUX', n_regionkey + 1, 1) AS area_type,
  CAST(3000000 + n_nationkey AS VARCHAR) AS area_code, n_name AS area_name,
  CAST(11000 + n_regionkey AS VARCHAR) AS district_code, r_name AS district_name
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
cte("f_segment", (), """SELECT * FROM (VALUES ('AUTOMOBILE', 1), ('BUILDING', 2), ('FURNITURE', 3), ('HOUSEHOLD', 4),
  ('MACHINERY', 5)) AS v(segment, industry_no)""")
cte("f_customer", ("f_area", "f_segment"), """SELECT c_custkey, area_no, area_type, area_code, industry_no,
  'CS10000' || industry_no AS industry_code
  FROM customer JOIN f_area ON c_nationkey = area_no JOIN f_segment ON c_mktsegment = segment""")
cte("f_order", ("f_customer",), """SELECT o_orderkey, c_custkey, area_no, area_type, area_code, industry_no, industry_code,
  o_orderpriority, dayofweek(o_orderdate) + 1 AS dow,
  CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter_idx
  FROM orders JOIN f_customer ON o_custkey = c_custkey""")
cte("f_line", ("f_order",), """SELECT f_order.* REPLACE (
   CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN area_no ELSE 90 + strpos('ADRUX', area_type) END AS area_no,
   CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN area_code ELSE '309999' || strpos('ADRUX', area_type) END AS area_code),
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem JOIN f_order ON l_orderkey = o_orderkey""")
cte("f_sales", ("f_line",), """SELECT area_type, area_code, industry_code, quarter_idx, area_no, industry_no,
  CAST(sum(amount) AS BIGINT) AS sales_amount, count(*) AS sales_count FROM f_line GROUP BY ALL""")
cte("f_life", ("f_order",), """SELECT c_custkey, min(quarter_idx) AS first_q, max(quarter_idx) AS last_q
  FROM f_order GROUP BY c_custkey""")
cte("f_stores", ("f_order", "f_life"), """SELECT area_type, area_code, industry_code, quarter_idx, area_no, industry_no,
  count(DISTINCT CASE WHEN o.c_custkey % 5 <> 0 THEN o.c_custkey END) AS store_count,
  count(DISTINCT o.c_custkey) AS similar_store_count,
  count(DISTINCT CASE WHEN o.c_custkey % 5 = 0 THEN o.c_custkey END) AS franchise_store_count,
  count(DISTINCT CASE WHEN first_q = quarter_idx THEN o.c_custkey END) AS opened_store_count,
  count(DISTINCT CASE WHEN last_q = quarter_idx THEN o.c_custkey END) AS closed_store_count
  FROM f_order o JOIN f_life l ON o.c_custkey = l.c_custkey GROUP BY ALL""")
cte("f_panel", ("f_sales", "f_stores"), """SELECT coalesce(s.area_type, t.area_type) AS area_type,
  coalesce(s.area_code, t.area_code) AS area_code, coalesce(s.industry_code, t.industry_code) AS industry_code,
  coalesce(s.quarter_idx, t.quarter_idx) AS quarter_idx, sales_amount, sales_count, store_count, similar_store_count,
  CASE WHEN (t.area_no * 7 + t.quarter_idx) % 53 = 0 THEN NULL ELSE franchise_store_count END AS franchise_store_count,
  opened_store_count, closed_store_count
  FROM f_sales s FULL JOIN f_stores t ON s.area_code = t.area_code AND s.industry_code = t.industry_code
   AND s.quarter_idx = t.quarter_idx""")
cte("f_series", ("f_area", "f_segment"), """SELECT area_type, area_code, area_name, 'CS10000' || industry_no AS industry_code
  FROM f_area CROSS JOIN f_segment""")
cte("f_breakdown", ("f_line",), """SELECT area_type, area_code, industry_code, quarter_idx, area_no, industry_no, 'DAY' AS grp,
  CAST(dow AS VARCHAR) AS point, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS cnt FROM f_line GROUP BY ALL
  UNION ALL SELECT area_type, area_code, industry_code, quarter_idx, area_no, industry_no, 'PRIORITY',
  substr(o_orderpriority, 1, 1), CAST(sum(amount) AS BIGINT), count(*) FROM f_line GROUP BY ALL""")
cte("f_dirty_sales", ("f_sales", "f_area"), """SELECT k * 10 + copy AS line,
  CASE WHEN k % 97 = 6 THEN '19950' ELSE (quarter_idx // 4) || '' || (quarter_idx % 4 + 1) END AS quarter, area_type,
  CASE k % 97 WHEN 3 THEN '3000999' WHEN 7 THEN '30001' ELSE area_code END AS area_code,
  CASE WHEN k % 97 = 8 THEN area_name || '*' ELSE area_name END AS area_name,
  CASE WHEN k % 97 = 5 THEN 'C100' ELSE industry_code END AS industry_code,
  'IND ' || industry_no || CASE WHEN k % 97 = 9 THEN ' renamed' ELSE '' END AS industry_name,
  quarter_idx // 4 AS year,
  CASE k % 97 WHEN 0 THEN '-5' WHEN 1 THEN '' WHEN 2 THEN 'x1' WHEN 10 THEN ' 00' || sales_amount || ' '
   WHEN 11 THEN 'UNSAFE:9007199254740993' WHEN 12 THEN '1234567890123456789' ELSE CAST(sales_amount AS VARCHAR) END AS sales_amount,
  CASE k % 97 WHEN 13 THEN '99999999999999999' WHEN 14 THEN '-1' WHEN 15 THEN ' ' ELSE CAST(sales_count AS VARCHAR) END AS sales_count
  FROM (SELECT s.*, coalesce(a.area_name, 'HEAD OFFICE') AS area_name, CAST(s.area_no AS BIGINT) * 10000 + industry_no * 1000 + (quarter_idx - 7900) AS k
        FROM f_sales s LEFT JOIN f_area a ON s.area_code = a.area_code) x
  JOIN (VALUES (1), (2)) c(copy) ON copy = 1 OR k % 97 = 4""")
cte("f_dirty_stores", ("f_stores",), """SELECT * REPLACE (similar_store_count
   + CASE WHEN (area_no * 10000 + industry_no * 1000 + quarter_idx - 7900) % 97 = 0 THEN 1 ELSE 0 END AS similar_store_count)
  FROM f_stores""")
