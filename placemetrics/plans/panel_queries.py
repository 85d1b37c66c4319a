"""Registered queries over the panel proxies: validation, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placemetrics.functions import quarter as Q
from placemetrics.functions.money import wide
from placemetrics.operators import panel as P
from placemetrics.operators import quality as D
from placemetrics.operators import survival as S
from placemetrics.plans import proxies as X
from placemetrics.plans.proxies import Tables
from placemetrics.plans.sqlbase import sql
from placemetrics.session import cut

QUERIES, ORACLE = {}, {}


def query(name: str, needs=None, body: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(needs, body) if needs else body
        return fn
    return add


K = "area_type, area_code, industry_code, quarter_idx"


# ---------------------------------------------------------------- validation

@query("key_quality", ["f_dirty_sales"], r"""
SELECT code, count(*) AS row_count FROM (
  SELECT unnest(list_filter([
    CASE WHEN NOT regexp_full_match(quarter, '\d{4}[1-4]') THEN 'INVALID_QUARTER' END,
    CASE WHEN area_type NOT IN ('A','D','R','U') THEN 'INVALID_AREA_TYPE' END,
    CASE WHEN NOT regexp_full_match(area_code, '\d{7}') THEN 'INVALID_AREA_CODE' END,
    CASE WHEN NOT regexp_full_match(industry_code, '[A-Z]{2}\d{6}') THEN 'INVALID_INDUSTRY_CODE' END,
    CASE WHEN regexp_full_match(quarter, '\d{4}[1-4]') AND area_type IN ('A','D','R','U') AND regexp_full_match(area_code, '\d{7}')
      AND regexp_full_match(industry_code, '[A-Z]{2}\d{6}') THEN 'VALID' END], lambda x: x IS NOT NULL)) AS code
  FROM f_dirty_sales) GROUP BY code""")
def key_quality(t):
    rows = D.with_key_issues(X.f_dirty_sales(t))
    codes = F.when(F.size("issues") == 0, F.array(F.lit("VALID"))).otherwise(F.col("issues"))
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("row_count"))


@query("cell_quality", ["f_dirty_sales"], r"""
SELECT line,
  CASE WHEN trim(sales_amount) = '' THEN 'NON_NUMERIC_AMOUNT' WHEN trim(sales_amount) LIKE '-%' THEN 'NEGATIVE_AMOUNT'
       WHEN NOT regexp_full_match(trim(sales_amount), '\d+') THEN 'NON_NUMERIC_AMOUNT'
       WHEN length(trim(sales_amount)) > 18 THEN 'NON_NUMERIC_AMOUNT' END AS amount_issue,
  CASE WHEN regexp_full_match(trim(sales_amount), '\d{1,18}') THEN CAST(trim(sales_amount) AS BIGINT) END AS amount,
  CASE WHEN trim(sales_count) = '' THEN 'NON_NUMERIC_COUNT' WHEN trim(sales_count) LIKE '-%' THEN 'NEGATIVE_AMOUNT'
       WHEN CAST(trim(sales_count) AS HUGEINT) > 9007199254740991 THEN 'NON_NUMERIC_COUNT' END AS count_issue,
  CASE WHEN TRY_CAST(trim(sales_count) AS HUGEINT) BETWEEN 0 AND 9007199254740991 THEN CAST(trim(sales_count) AS BIGINT) END AS cnt
FROM f_dirty_sales""")
def cell_quality(t):
    a, c = D.parse_amount(F.col("sales_amount")), D.parse_count(F.col("sales_count"))
    return (X.f_dirty_sales(t).select("line", a.alias("a"), c.alias("c"))
             .select("line", F.col("a.issue").alias("amount_issue"), F.col("a.value").cast("bigint").alias("amount"),
                     F.col("c.issue").alias("count_issue"), F.col("c.value").alias("cnt")))


_DIM_SQL = r"""
SELECT code, count(*) AS row_count FROM (
 SELECT unnest(CASE WHEN len(codes) = 0 THEN [CASE WHEN rn = 1 THEN 'KEPT' ELSE 'DUPLICATE_KEY' END] ELSE codes END) AS code FROM (
  SELECT line, codes, row_number() OVER (PARTITION BY len(codes) > 0, area_type, area_code ORDER BY line) AS rn FROM (
   SELECT c_custkey AS line, area_type, area_code, list_filter([
     CASE WHEN area_type NOT IN ('A','D','R','U') THEN 'INVALID_AREA_TYPE' END,
     CASE WHEN NOT regexp_full_match(area_code, '\d{7}') THEN 'INVALID_AREA_CODE' END,
     CASE WHEN NOT regexp_full_match(district_code, '\d{5}') THEN 'INVALID_DISTRICT_CODE' END,
     CASE WHEN trim(area_name) = '' THEN 'MISSING_NAME' END], lambda x: x IS NOT NULL) AS codes
   FROM (SELECT c_custkey, substr('ADRUX', c_custkey % 5 + 1, 1) AS area_type,
          CASE WHEN c_custkey % 17 = 0 THEN '30' ELSE CAST(3000000 + c_custkey % 400 AS VARCHAR) END AS area_code,
          CASE WHEN c_custkey % 19 = 0 THEN '' ELSE CAST(11000 + c_nationkey AS VARCHAR) END AS district_code,
          CASE WHEN c_custkey % 23 = 0 THEN '  ' ELSE c_name END AS area_name FROM customer)))) GROUP BY code"""


@query("dim_quality", None, _DIM_SQL)
def dim_quality(t):
    k = F.col("c_custkey")
    rows = t.customer.select(
        k.alias("line"), F.substring(F.lit("ADRUX"), (k % 5 + 1).cast("int"), F.lit(1)).alias("area_type"),
        F.when(k % 17 == 0, "30").otherwise((k % 400 + 3000000).cast("string")).alias("area_code"),
        F.when(k % 19 == 0, "").otherwise((F.col("c_nationkey") + 11000).cast("string")).alias("district_code"),
        F.when(k % 23 == 0, "  ").otherwise(F.col("c_name")).alias("area_name"))
    checked = rows.withColumn("issues", D.issue_array([
        ("INVALID_AREA_TYPE", ~F.trim("area_type").isin(*D.AREA_TYPES)),
        ("INVALID_AREA_CODE", ~F.trim("area_code").rlike(D.AREA_CODE_PATTERN)),
        ("INVALID_DISTRICT_CODE", ~F.trim("district_code").rlike(D.DISTRICT_CODE_PATTERN)),
        ("MISSING_NAME", F.trim("area_name") == "")]))
    ok, bad = D.split_by_issues(checked)
    first = D.dedupe_first(ok.select("area_type", "area_code", "line"), ["area_type", "area_code"], ["line"])
    kept = first.agg(F.count(F.lit(1)).alias("KEPT"), F.sum(F.col("copies") - 1).alias("DUPLICATE_KEY"))
    kept = kept.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("row_count"))
                                           for c in ("KEPT", "DUPLICATE_KEY")])).alias("x")).select("x.*")
    return bad.groupBy("code").agg(F.count(F.lit(1)).alias("row_count")).unionByName(kept)


@query("unknown_keys", ["f_dirty_sales", "f_area"], """
SELECT CASE WHEN a.area_code IS NULL THEN 'UNKNOWN_AREA' ELSE 'KNOWN' END AS outcome, count(*) AS row_count,
  min(d.line) AS first_line FROM f_dirty_sales d LEFT JOIN f_area a USING (area_type, area_code) GROUP BY 1""")
def unknown_keys(t):
    known, unknown = D.require_dim(X.f_dirty_sales(t), X.f_area(t), P.AREA)
    def tally(df, name):
        return df.groupBy(F.lit(name).alias("outcome")).agg(F.count(F.lit(1)).alias("row_count"),
                                                            F.min("line").alias("first_line"))
    return tally(known, "KNOWN").unionByName(tally(unknown, "UNKNOWN_AREA"))


@query("dup_keys", None, """
SELECT l_linenumber, count(*) AS keys, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicates,
  CAST(sum(first_cents) AS BIGINT) AS kept_cents FROM (
 SELECT l_orderkey, l_linenumber, count(*) AS n,
   list(CAST(round(l_extendedprice * 100) AS BIGINT) ORDER BY l_shipdate, l_partkey, l_suppkey, round(l_extendedprice * 100))[1] AS first_cents
 FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def dup_keys(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
                             F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"))
    first = D.dedupe_first(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "price"])
    return first.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("row_count"), F.sum(F.col("copies") - 1).alias("duplicates"),
        F.sum("price").alias("kept_cents"))


@query("identity_check", ["f_dirty_stores"], """
SELECT industry_code, count(*) AS row_count,
  count(CASE WHEN store_count + franchise_store_count <> similar_store_count THEN 1 END) AS violations,
  min(CASE WHEN store_count + franchise_store_count <> similar_store_count THEN quarter_idx END) AS first_quarter
FROM f_dirty_stores GROUP BY 1""")
def identity_check(t):
    c = P.check_identity(X.f_dirty_stores(t), [F.col("store_count"), F.col("franchise_store_count")],
                         F.col("similar_store_count"))
    return c.groupBy("industry_code").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(F.when(~F.col("identity_ok"), 1)).alias("violations"),
        F.min(F.when(~F.col("identity_ok"), F.col("quarter_idx"))).alias("first_quarter"))


_POINTS = [("DAY", str(i)) for i in range(1, 8)] + [("PRIORITY", str(i)) for i in range(1, 6)]
_BD_CELLS = ",\n ".join(
    f"CASE WHEN k % 97 = 10 THEN '' WHEN k % 97 = 11 AND {i} = 3 THEN ' ' WHEN k % 97 = 12 AND {i} = 5 THEN '1x' "
    f"WHEN k % 97 = 13 AND {i} = 8 THEN '-4' ELSE CAST(coalesce(sum(amount) FILTER (grp = '{g}' AND point = '{p}'), 0) AS VARCHAR) END"
    for i, (g, p) in enumerate(_POINTS))


@query("breakdown_quality", ["f_breakdown"], rf"""
, cells AS (SELECT {K}, k, list_value({_BD_CELLS}) AS cells, CAST(sum(cnt) FILTER (grp = 'DAY') AS VARCHAR) AS n
  FROM (SELECT *, area_no * 10000 + industry_no * 1000 + (quarter_idx - 7900) AS k FROM f_breakdown) GROUP BY {K}, k)
SELECT {K}, CASE WHEN k % 97 = 10 THEN 'ABSENT' WHEN k % 97 IN (11, 12, 13) THEN 'REJECTED' ELSE 'OK' END AS status,
 CASE WHEN k % 97 IN (11, 12) THEN 'NON_NUMERIC_AMOUNT' WHEN k % 97 = 13 THEN 'NEGATIVE_AMOUNT' END AS issue,
 CASE WHEN k % 97 NOT IN (10, 11, 12, 13) THEN CAST(list_sum(list_transform(cells, lambda c: CAST(c AS BIGINT))) AS BIGINT) END AS total
FROM cells""")
def breakdown_quality(t):
    b = X.f_breakdown(t).withColumn("k", X._dirty_key().cast("bigint"))
    m = F.col("k") % 97

    def cell(i, measure):
        g, p = _POINTS[i]
        value = F.coalesce(F.sum(F.when((F.col("grp") == g) & (F.col("point") == p), F.col(measure))), F.lit(0)).cast("string")
        if measure == "count":
            return F.when(m == 10, F.lit("")).otherwise(value)
        out = F.when(m == 10, F.lit(""))
        for res, at, text in ((11, 3, " "), (12, 5, "1x"), (13, 8, "-4")):
            if at == i:
                out = out.when(m == res, F.lit(text))
        return out.otherwise(value)

    wide_rows = b.groupBy(*P.KEY, "k").agg(
        F.array(*[cell(i, "amount") for i in range(12)]).alias("amounts"),
        F.array(*[cell(i, "count") for i in range(12)]).alias("counts"),
        F.when(m == 10, F.lit("")).otherwise(F.sum(F.when(F.col("grp") == "DAY", F.col("count"))).cast("string")).alias("n"))
    r = wide_rows.select(*P.KEY, D.parse_breakdown(F.col("n"), F.col("amounts"), F.col("counts")).alias("r"))
    return r.select(*P.KEY, "r.status", "r.issue",
                    F.aggregate("r.amounts", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("total"))


@query("issue_ledger", ["f_dirty_sales"], r"""
, bad AS (SELECT line, unnest(list_filter([
    CASE WHEN NOT regexp_full_match(quarter, '\d{4}[1-4]') THEN 'INVALID_QUARTER' END,
    CASE WHEN area_type NOT IN ('A','D','R','U') THEN 'INVALID_AREA_TYPE' END,
    CASE WHEN NOT regexp_full_match(area_code, '\d{7}') THEN 'INVALID_AREA_CODE' END,
    CASE WHEN NOT regexp_full_match(industry_code, '[A-Z]{2}\d{6}') THEN 'INVALID_INDUSTRY_CODE' END], lambda x: x IS NOT NULL)) AS code
  FROM f_dirty_sales)
SELECT code, count(*) AS issue_count, array_to_string(list_sort(list(line) FILTER (rn <= 50)), ',') AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY line) AS rn FROM bad) GROUP BY code""")
def issue_ledger(t):
    _, bad = D.split_by_issues(D.with_key_issues(X.f_dirty_sales(t)))
    return D.issue_ledger(bad.select("line", "code"), "line").withColumn(
        "examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


_EXPECTED = {"sales_rows": 1, "duplicate_keys": 0, "unknown_areas": 0}


@query("release_checks", ["f_dirty_sales", "f_area"], """
, m AS (SELECT (SELECT count(*) FROM f_dirty_sales) AS sales_rows,
  (SELECT count(*) - count(DISTINCT (quarter, area_type, area_code, industry_code)) FROM f_dirty_sales) AS duplicate_keys,
  (SELECT count(*) FROM f_dirty_sales d WHERE NOT EXISTS (SELECT 1 FROM f_area a WHERE a.area_type = d.area_type AND a.area_code = d.area_code)) AS unknown_areas)
SELECT 'sales_rows' AS name, CAST(1 AS BIGINT) AS expected, sales_rows AS actual, sales_rows = 1 AS passed FROM m
UNION ALL SELECT 'duplicate_keys', 0, duplicate_keys, duplicate_keys = 0 FROM m
UNION ALL SELECT 'unknown_areas', 0, unknown_areas, unknown_areas = 0 FROM m""")
def release_checks(t):
    rows = X.f_dirty_sales(t)
    known = X.f_area(t).select(*P.AREA, F.lit(1).alias("_known"))
    per_key = rows.groupBy("quarter", *P.AREA, "industry_code").agg(F.count(F.lit(1)).alias("_n")).join(known, list(P.AREA), "left")
    actual = per_key.agg(F.sum("_n").alias("sales_rows"), F.sum(F.col("_n") - 1).alias("duplicate_keys"),
                         F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("unknown_areas"))
    return D.check_table(actual, _EXPECTED)


@query("period_coverage", ["f_sales"], """
SELECT CAST(q AS INTEGER) AS quarter_idx, 'MISSING' AS outcome FROM generate_series(7976, 8004) g(q)
 WHERE q NOT IN (SELECT quarter_idx FROM f_sales)
UNION ALL SELECT DISTINCT quarter_idx, 'UNEXPECTED' FROM f_sales WHERE quarter_idx NOT BETWEEN 7976 AND 8004""")
def period_coverage(t):
    return D.check_coverage(X.f_sales(t), "quarter_idx", 7976, 8004)


@query("sibling_sets", ["f_sales"], f"""
, s AS (SELECT DISTINCT area_type, area_code, quarter_idx FROM f_sales WHERE sales_amount % 7 <> 0 OR area_type = 'A'),
m AS (SELECT area_type, count(DISTINCT area_code) AS members FROM s GROUP BY 1),
v AS (SELECT area_type, count(DISTINCT quarter_idx) AS vals FROM s GROUP BY 1),
p AS (SELECT area_type, count(*) AS pairs FROM s GROUP BY 1)
SELECT area_type, members, vals AS "values", pairs, members * vals = pairs AS same_set FROM m JOIN v USING (area_type) JOIN p USING (area_type)""")
def sibling_sets(t):
    s = X.f_sales(t).where("sales_amount % 7 <> 0 OR area_type = 'A'")
    return D.sibling_sets(s, ["area_type"], "area_code", "quarter_idx")


@query("name_conflicts", ["f_dirty_sales"], """
SELECT industry_code, coalesce((list(industry_name ORDER BY year DESC, line DESC))[1], industry_code) AS canonical_name,
 count(DISTINCT industry_name) AS name_count, count(DISTINCT industry_name) > 1 AS conflict FROM f_dirty_sales GROUP BY 1""")
def name_conflicts(t):
    return D.canonical_names(X.f_dirty_sales(t), "industry_code", "industry_name", "year", "line")


@query("observed_name", ["f_dirty_sales", "f_area"], """
SELECT a.area_type, a.area_code, a.area_name, (list(d.area_name ORDER BY d.line) FILTER (d.area_name <> a.area_name))[1] AS observed_name,
 count(DISTINCT d.area_name) AS names_seen FROM f_area a JOIN f_dirty_sales d ON a.area_type = d.area_type AND a.area_code = d.area_code
GROUP BY 1, 2, 3 HAVING count(CASE WHEN d.area_name <> a.area_name THEN 1 END) > 0""")
def observed_name(t):
    fact = X.f_dirty_sales(t).select(*P.AREA, F.col("area_name").alias("fact_name"), "line")
    return D.observed_names(X.f_area(t), fact, P.AREA, "area_name", "fact_name", "line")


@query("ambiguous_codes", None, """
SELECT code, count(DISTINCT kind) AS kinds_count, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM (
 SELECT CAST(c_custkey % 211 AS VARCHAR) AS code, CASE WHEN c_custkey % 211 % 3 = 0 THEN c_mktsegment ELSE 'FIXED' END AS kind FROM customer)
GROUP BY code HAVING count(DISTINCT kind) > 1""")
def ambiguous_codes(t):
    code = F.col("c_custkey") % 211
    d = t.customer.select(code.cast("string").alias("code"),
                          F.when(code % 3 == 0, F.col("c_mktsegment")).otherwise("FIXED").alias("kind"))
    return D.ambiguous_codes(d, "code", "kind").withColumn("kinds", F.array_join("kinds", ","))


@query("shrink_guard", None, """
, c AS (SELECT s_nationkey % 12 AS source, count(*) * (s_nationkey % 12 % 5) AS fetched FROM supplier GROUP BY 1),
p AS (SELECT s_nationkey % 12 AS source, count(*) * 3 AS previous FROM supplier WHERE s_nationkey % 12 <> 7 GROUP BY 1)
SELECT source, fetched, previous, CASE WHEN fetched = 0 THEN 'EMPTY' WHEN fetched * 2 < previous THEN 'SHRUNK' ELSE 'OK' END AS outcome
FROM c LEFT JOIN p USING (source)""".replace(", c AS", "WITH c AS", 1))
def shrink_guard(t):
    source = F.col("s_nationkey") % 12
    counts = t.supplier.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    current = counts.select("source", (F.col("n") * (F.col("source") % 5)).alias("fetched"))
    previous = counts.where("source <> 7").select("source", (F.col("n") * 3).alias("fetched"))
    return D.shrink_guard(current, previous, "source")


@query("table_profile", ["f_panel"], """
SELECT count(*) AS row_count, CAST(count(*) - count(DISTINCT (area_type, area_code, industry_code, quarter_idx)) AS BIGINT) AS duplicate_keys,
 count(CASE WHEN area_code IS NULL OR area_type IS NULL OR industry_code IS NULL OR quarter_idx IS NULL THEN 1 END) AS missing_key_rows,
 CAST(5 * count(*) + 2 * count(*) - count(sales_amount) - count(sales_count) - count(store_count) - count(similar_store_count)
  - count(franchise_store_count) - count(opened_store_count) - count(closed_store_count) AS BIGINT) AS null_cells,
 count(CASE WHEN sales_amount < 0 THEN 1 END) AS negative_amounts,
 count(CASE WHEN sales_amount = 0 THEN 1 END) + count(CASE WHEN closed_store_count = 0 THEN 1 END) AS zero_amounts,
 count(DISTINCT area_code) AS areas, count(DISTINCT quarter_idx) AS periods, CAST(11 AS BIGINT) AS column_count FROM f_panel""")
def table_profile(t):
    return D.table_profile(X.f_panel(t), P.KEY, "area_code", "quarter_idx", ["sales_amount", "closed_store_count"])


# ---------------------------------------------------------------- joins

@query("panel_full_outer", ["f_sales", "f_stores"], f"""
SELECT coalesce(s.area_type, t.area_type) AS area_type, coalesce(s.area_code, t.area_code) AS area_code,
 coalesce(s.industry_code, t.industry_code) AS industry_code, coalesce(s.quarter_idx, t.quarter_idx) AS quarter_idx,
 sales_amount, sales_count, store_count, similar_store_count, franchise_store_count, opened_store_count, closed_store_count
FROM (SELECT * FROM f_sales WHERE industry_no IN (2, 4, 5)) s FULL JOIN (SELECT * FROM f_stores WHERE industry_no IN (2, 4, 5)) t
 ON s.area_code = t.area_code AND s.industry_code = t.industry_code AND s.quarter_idx = t.quarter_idx""")
def panel_full_outer(t):
    return P.build_panel(X.f_sales_keyed(t), X.f_stores_keyed(t), X.SUPPORTED)


@query("join_audit", None, """
SELECT count(CASE WHEN l.k IS NOT NULL AND o.k IS NOT NULL THEN 1 END) AS both, count(CASE WHEN o.k IS NULL THEN 1 END) AS left_only,
 count(CASE WHEN l.k IS NULL THEN 1 END) AS right_only, count(CASE WHEN l.n > 1 OR o.n > 1 THEN 1 END) AS not_one_to_one
FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l
FULL JOIN (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON l.k = o.k""")
def join_audit(t):
    return P.join_audit(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")), ["k"])


@query("orphan_rows", None, """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def orphan_rows(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return P.orphans(t.orders, lines, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("complete_grid", ["f_series", "f_panel"], """
SELECT s.area_type, s.area_code, s.industry_code, p.quarters, p.sales FROM (SELECT * FROM f_series WHERE industry_code IN ('CS100002','CS100004','CS100005')) s LEFT JOIN
 (SELECT area_code, industry_code, count(*) AS quarters, CAST(sum(sales_amount) AS BIGINT) AS sales FROM f_panel
  WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_panel) GROUP BY 1, 2) p ON s.area_code = p.area_code AND s.industry_code = p.industry_code""")
def complete_grid(t):
    panel = cut(X.f_panel(t))
    newest = panel.agg(F.max("quarter_idx").alias("quarter_idx"))
    facts = panel.join(F.broadcast(newest), "quarter_idx").groupBy(*P.SERIES).agg(
        F.count(F.lit(1)).alias("quarters"), F.sum("sales_amount").alias("sales"))
    return P.complete_areas(X.f_area(t).select(*P.AREA), X.f_industry(t).where("supported"), facts)


@query("lookup_outcome", ["f_area"], r"""
, req AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE substr('ADRUX', c_nationkey % 5 + 1, 1) END AS area_type,
  CASE c_custkey % 13 WHEN 0 THEN 'bad' WHEN 1 THEN '3000999' ELSE CAST(3000000 + c_nationkey AS VARCHAR) END AS area_code,
  CASE c_custkey % 11 WHEN 0 THEN 'X1' WHEN 1 THEN 'CS100009' ELSE 'CS10000' || (c_custkey % 5 + 1) END AS industry_code FROM customer),
dim AS (SELECT area_type, area_code FROM f_area UNION ALL SELECT 'Z', area_code FROM f_area WHERE area_no % 6 = 0),
per AS (SELECT area_code, count(DISTINCT area_type) AS n, min(area_type) AS only_type FROM dim GROUP BY 1)
SELECT c_custkey, outcome, CASE WHEN outcome = 'OK' THEN coalesce(t, only_type) END AS resolved_area_type FROM (
SELECT c_custkey, d.area_type AS t, only_type, CASE WHEN NOT regexp_full_match(r.area_code, '\d{7}') THEN 'INVALID_AREA_CODE'
 WHEN NOT regexp_full_match(industry_code, '[A-Z]{2}\d{6}') THEN 'INVALID_INDUSTRY_CODE'
 WHEN r.area_type IS NOT NULL AND d.area_type IS NULL THEN 'AREA_NOT_FOUND'
 WHEN r.area_type IS NULL AND per.n IS NULL THEN 'AREA_NOT_FOUND'
 WHEN r.area_type IS NULL AND per.n > 1 THEN 'AMBIGUOUS_AREA_CODE'
 WHEN industry_code = 'CS100009' THEN 'INVALID_INDUSTRY_CODE'
 WHEN industry_code NOT IN ('CS100002', 'CS100004', 'CS100005') THEN 'UNSUPPORTED_INDUSTRY' ELSE 'OK' END AS outcome
FROM req r LEFT JOIN per ON r.area_code = per.area_code LEFT JOIN dim d ON d.area_code = r.area_code AND d.area_type = r.area_type)""")
def lookup_outcome(t):
    k = F.col("c_custkey")
    req = t.customer.select(
        "c_custkey", F.when(k % 5 != 0, F.substring(F.lit("ADRUX"), F.col("c_nationkey") % 5 + 1, F.lit(1))).alias("area_type"),
        F.when(k % 13 == 0, "bad").when(k % 13 == 1, "3000999").otherwise((F.col("c_nationkey") + 3000000).cast("string")).alias("area_code"),
        F.when(k % 11 == 0, "X1").when(k % 11 == 1, "CS100009").otherwise(F.concat(F.lit("CS10000"), (k % 5 + 1).cast("string"))).alias("industry_code"))
    areas = X.f_area(t)
    areas = areas.select(*P.AREA).unionByName(areas.where("area_no % 6 = 0").select(F.lit("Z").alias("area_type"), "area_code"))
    return P.resolve_requests(req, areas, X.f_industry(t)).select("c_custkey", "outcome", "resolved_area_type")


@query("latest_common_quarter", ["f_sales", "f_stores"], """
SELECT max(a.quarter_idx) AS quarter_idx FROM f_sales a JOIN f_stores b USING (quarter_idx)
WHERE quarter_idx BETWEEN 7997 AND 8004 AND a.sales_count > 1""")
def latest_common_quarter(t):
    return P.latest_common_quarter(X.f_sales(t).where("sales_count > 1"), X.f_stores(t), 8004)


# ---------------------------------------------------------------- aggregates

@query("district_counts", ["f_area"], "SELECT district_code, district_name, count(*) AS area_count FROM f_area GROUP BY 1, 2")
def district_counts(t):
    return P.district_counts(X.f_area(t))


@query("data_status", ["f_series", "f_panel"], """
SELECT s.area_type, s.area_code, s.industry_code, coalesce(q, 0) AS quarters, coalesce(m, 0) AS missing_sales,
 CASE WHEN coalesce(q, 0) = 0 THEN 'NOT_PROVIDED' WHEN m > 0 THEN 'PARTIAL' ELSE 'AVAILABLE' END AS data_status
FROM f_series s LEFT JOIN (SELECT area_code, industry_code, count(*) AS q, count(*) - count(sales_amount) AS m FROM f_panel
 WHERE quarter_idx BETWEEN 7984 AND 7985 GROUP BY 1, 2) p ON s.area_code = p.area_code AND s.industry_code = p.industry_code""")
def data_status(t):
    panel = X.f_panel(t).where("quarter_idx BETWEEN 7984 AND 7985")
    return P.data_status(X.f_series(t).select(*P.SERIES), panel)


@query("complete_keys", ["f_stores"], """
SELECT count(CASE WHEN n = 27 THEN 1 END) AS complete, count(*) AS observed
FROM (SELECT area_code, industry_code, count(DISTINCT quarter_idx) AS n FROM f_stores GROUP BY 1, 2)""")
def complete_keys(t):
    return P.complete_keys(X.f_stores(t), P.SERIES, "quarter_idx", 27)


@query("breakdown_shares", ["f_breakdown"], f"""
SELECT {K}, grp, point, amount, CASE WHEN tot = 0 THEN 0 ELSE CAST(amount * 1000 // tot AS BIGINT) END AS share_permille
FROM (SELECT *, CAST(sum(amount) OVER (PARTITION BY {K}, grp) AS HUGEINT) AS tot FROM f_breakdown)""")
def breakdown_shares(t):
    return P.breakdown_shares(X.f_breakdown(t), [*P.KEY, "grp"]).select(*P.KEY, "grp", "point", "amount", "share_permille")


@query("trend_stats", ["f_panel"], """
SELECT area_type, area_code, industry_code, count(sales_amount) AS observed_quarters, max(sales_amount) AS max_sales, max(store_count) AS max_stores
FROM f_panel GROUP BY 1, 2, 3""")
def trend_stats(t):
    return P.trend_stats(X.f_panel(t))


# ---------------------------------------------------------------- quarters and windows

@query("quarter_math", None, """
SELECT o_orderkey, y || '' || q AS quarter, CASE WHEN q = 1 THEN (y - 1) || '4' ELSE y || '' || (q - 1) END AS previous,
 y - 1 || '' || q AS year_ago, CASE WHEN q = 4 THEN (y + 1) || '1' ELSE y || '' || (q + 1) END AS next_one,
 y || '년 ' || q || '분기' AS label, CAST(2002 * 4 - (y * 4 + q - 1) AS INTEGER) AS quarters_to_2001q4,
 CASE WHEN y = 2001 THEN y || '년 ' || q || '분기~4분기' ELSE y || '년 ' || q || '분기~2001년 4분기' END AS period_label,
 y || 'Q' || q || '-2001Q4' AS period_code
FROM (SELECT o_orderkey, year(d) AS y, quarter(d) AS q FROM (SELECT o_orderkey, o_orderdate + INTERVAL 18 HOUR + INTERVAL 9 HOUR AS d FROM orders))""")
def quarter_math(t):
    o = t.orders.select("o_orderkey", Q.quarter_at(F.col("o_orderdate") + F.expr("INTERVAL 18 HOURS")).alias("i"))
    o = o.withColumn("quarter", Q.quarter_code(F.col("i")))
    end = F.lit(2001 * 4 + 3)
    return o.select("o_orderkey", "quarter", Q.shift_quarter(F.col("quarter"), -1).alias("previous"),
                    Q.shift_quarter(F.col("quarter"), -4).alias("year_ago"), Q.shift_quarter(F.col("quarter"), 1).alias("next_one"),
                    Q.quarter_label(F.col("i")).alias("label"),
                    F.size(Q.quarters_between(F.col("i"), end)).alias("quarters_to_2001q4"),
                    Q.period_label(F.col("i"), end).alias("period_label"), Q.period_code(F.col("i"), end).alias("period_code"))


@query("exact_lag", ["f_panel"], f"""
SELECT p.area_type, p.area_code, p.industry_code, p.quarter_idx, p.sales_amount, q.sales_amount AS prior_sales
FROM f_panel p LEFT JOIN f_panel q ON p.area_code = q.area_code AND p.industry_code = q.industry_code AND q.quarter_idx = p.quarter_idx - 4""")
def exact_lag(t):
    return X.f_panel(t).select(*P.KEY, "sales_amount", S.lag_exact(F.col("sales_amount")).alias("prior_sales"))


@query("trailing_window", ["f_panel"], """
SELECT p.area_type, p.area_code, p.industry_code, p.quarter_idx,
 CASE WHEN count(CASE WHEN q.sales_amount IS NOT NULL AND q.similar_store_count IS NOT NULL THEN 1 END) = 4 THEN CAST(sum(q.sales_amount) AS BIGINT) END AS window_sales,
 CASE WHEN count(CASE WHEN q.sales_amount IS NOT NULL AND q.similar_store_count IS NOT NULL THEN 1 END) = 4 THEN CAST(sum(q.similar_store_count) AS BIGINT) END AS window_stores
FROM f_panel p LEFT JOIN f_panel q ON p.area_code = q.area_code AND p.industry_code = q.industry_code AND q.quarter_idx BETWEEN p.quarter_idx - 3 AND p.quarter_idx
GROUP BY 1, 2, 3, 4""")
def trailing_window(t):
    return S.with_windows(X.f_panel(t)).select(*P.KEY, "window_sales", "window_stores")


@query("strict_sum", ["f_panel"], """
SELECT p.area_type, p.area_code, p.industry_code, p.quarter_idx,
 CASE WHEN count(q.closed_store_count) = 4 THEN CAST(sum(q.closed_store_count) AS BIGINT) END AS window_closed,
 CASE WHEN count(q.franchise_store_count) = 4 THEN CAST(sum(q.franchise_store_count) AS BIGINT) END AS window_franchise
FROM f_panel p LEFT JOIN f_panel q ON p.area_code = q.area_code AND p.industry_code = q.industry_code AND q.quarter_idx BETWEEN p.quarter_idx - 3 AND p.quarter_idx
GROUP BY 1, 2, 3, 4""")
def strict_sum(t):
    return X.f_panel(t).select(*P.KEY, S.sum_complete(F.col("closed_store_count"), -3, 0).alias("window_closed"),
                               S.sum_complete(F.col("franchise_store_count"), -3, 0).alias("window_franchise"))


@query("future_rate", ["f_panel"], """
SELECT p.area_type, p.area_code, p.industry_code, p.quarter_idx, round(CASE WHEN any_value(p.similar_store_count) > 0 AND count(q.closed_store_count) = 4
 THEN sum(q.closed_store_count) / any_value(p.similar_store_count) END, 9) AS future_closure_rate
FROM f_panel p LEFT JOIN f_panel q ON p.area_code = q.area_code AND p.industry_code = q.industry_code AND q.quarter_idx BETWEEN p.quarter_idx + 1 AND p.quarter_idx + 4
GROUP BY 1, 2, 3, 4""")
def future_rate(t):
    return S.with_windows(X.f_panel(t)).select(*P.KEY, F.round("future_closure_rate", 9).alias("future_closure_rate"))
