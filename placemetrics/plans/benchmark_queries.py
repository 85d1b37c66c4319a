"""Registered queries over rent, franchise and directory proxies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.money import cents
from placemetrics.operators import directory as B
from placemetrics.operators import franchise as FR
from placemetrics.operators import quality as D
from placemetrics.operators import rent as R
from placemetrics.operators.survival import constant_rows
from placemetrics.plans import proxies as X
from placemetrics.plans.proxies import Tables
from placemetrics.plans.sqlbase import cte, sql

QUERIES, ORACLE = {}, {}


def query(name: str, needs=None, body: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(needs, body) if needs else body
        return fn
    return add


# ---------------------------------------------------------------- rent proxy

ROOT = "서울"
BUILDINGS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
METRICS = ("RENT", "FLOOR_RENT", "VACANCY_RATE")
FLOOR_SRC = ("지하1층", "1층", "2층", "3층", "4층", "5층", "6층이상")
LATEST = "20214"


def table_defs(t: Tables) -> DataFrame:
    rows = [(f"T_{b}_{m}", b, m, "임대료" if m != "VACANCY_RATE" else "공실률", "천원/㎡" if m != "VACANCY_RATE" else "%")
            for b in BUILDINGS for m in METRICS]
    return constant_rows(t.spark, table_id=[r[0] for r in rows], building=[r[1] for r in rows], metric=[r[2] for r in rows],
                         item=[r[3] for r in rows], unit=[r[4] for r in rows])


def f_rent(t: Tables) -> DataFrame:
    """Parts as rent source rows; defects at fixed residues."""
    k, s = F.col("p_partkey"), F.col("p_size")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int")
    metric = F.element_at(F.array(*[F.lit(m) for m in METRICS]), (s % 3 + 1).cast("int"))
    cent = cents(F.col("p_retailprice")) * 37
    amount = F.when(metric == "VACANCY_RATE", cent % 10100000).otherwise(cent)
    text = F.concat(F.floor(amount / 100000).cast("string"), F.lit("."), F.lpad((amount % 100000).cast("string"), 5, "0"))
    path = F.when(brand == 1, F.lit(ROOT)).when(brand == 2, F.concat(F.lit(ROOT), F.lit(">강남"))).otherwise(
        F.concat(F.when(brand == 25, F.lit("부산")).otherwise(F.lit(ROOT)), F.lit(">"),
                 F.element_at(F.array(*[F.lit(g) for g in (*R.GROUP_ORDER, "외곽")]), (brand % 5 + 1).cast("int")),
                 F.lit(">"), F.col("p_brand")))
    base = "VACANCY_RATE"
    return t.part.select(
        k.alias("line"), F.concat(F.lit("T_"), F.col("p_type"), F.lit("_"), metric).alias("table_id"),
        F.when(k % 41 == 0, F.concat((k % 2 + 2020).cast("string"), F.lit("4"))).otherwise(
            F.concat((F.floor(k % 8 / 4) + 2020).cast("string"), F.lit("0"), (k % 4 + 1).cast("string"))).alias("period"),
        F.when(metric == "FLOOR_RENT", path).alias("group_name"), F.when(metric != "FLOOR_RENT", path).alias("class_name_full"),
        F.when(k % 43 == 0, F.lit("옥상")).otherwise(
            F.element_at(F.array(*[F.lit(f) for f in FLOOR_SRC]), (s % 7 + 1).cast("int"))).alias("class_name"),
        F.when(k % 37 == 0, F.lit("효용비율")).when(metric == base, F.lit("공실률")).otherwise(F.lit("임대료")).alias("item_name"),
        F.when(k % 47 == 0, F.lit("원")).when(metric == base, F.lit("%")).otherwise(F.lit("천원/㎡")).alias("unit_name"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 53 == 0, F.lit("n/a")).when(k % 59 == 0, F.concat(F.lit("-"), text))
         .otherwise(text).alias("value_text"))


def rent_obs(t: Tables) -> DataFrame:
    return R.parse_rent(f_rent(t), table_defs(t), ROOT, ["효용비율"])


def rent_valid(t: Tables) -> DataFrame:
    ok = rent_obs(t).where("issue IS NULL").select(*R.OBSERVATION_KEY, "line", "region_name", "region_level", "value")
    return D.dedupe_first(ok, list(R.OBSERVATION_KEY), ["line"])


def f_bridge(t: Tables) -> DataFrame:
    """Brand -> one to three nations, some brands absent."""
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int")
    return t.part.select("p_brand").distinct().where(n % 5 != 0).select(
        F.col("p_brand").alias("place"),
        F.transform(F.sequence(F.lit(0), n % 3), lambda i: ((n * 7 + i) % 25 + 11000).cast("string")).alias("district_codes"))


cte("f_rent", (), """SELECT *, CASE WHEN metric = 'VACANCY_RATE' THEN cent % 10100000 ELSE cent END AS amount FROM (
 SELECT p_partkey AS line, p_type AS building, p_brand, p_size, CAST(substr(p_brand, 7) AS INTEGER) AS b,
  (['RENT', 'FLOOR_RENT', 'VACANCY_RATE'])[p_size % 3 + 1] AS metric, CAST(round(p_retailprice * 100) AS BIGINT) * 37 AS cent
 FROM part)""")
cte("f_rent_obs", ("f_rent",), """SELECT line, building, metric, region_path, string_split(region_path, '>')[-1] AS region_name,
 len(string_split(region_path, '>')) AS region_level, CASE WHEN line % 41 <> 0 THEN (2020 + line % 8 // 4) || '' || (line % 4 + 1) END AS quarter,
 CASE WHEN metric <> 'FLOOR_RENT' THEN 'NONE' WHEN line % 43 <> 0 THEN (['B1','1F','2F','3F','4F','5F','6F_PLUS'])[p_size % 7 + 1] END AS floor,
 CASE WHEN line % 11 = 0 OR line % 53 = 0 THEN NULL WHEN line % 59 = 0 THEN -amount ELSE amount END AS amt,
 CASE WHEN b = 25 THEN 'OUT_OF_SCOPE' WHEN metric = 'FLOOR_RENT' AND line % 37 = 0 THEN 'IGNORED_ITEM' WHEN line % 37 = 0 THEN 'UNEXPECTED_ITEM'
  WHEN line % 47 = 0 THEN 'UNEXPECTED_UNIT' WHEN line % 41 = 0 THEN 'INVALID_PERIOD' WHEN metric = 'FLOOR_RENT' AND line % 43 = 0 THEN 'UNKNOWN_FLOOR'
  WHEN line % 11 = 0 THEN NULL WHEN line % 53 = 0 THEN 'NON_NUMERIC_VALUE' WHEN line % 59 = 0 AND amount > 0 THEN 'NEGATIVE_VALUE'
  WHEN metric = 'VACANCY_RATE' AND amount > 10000000 THEN 'RATE_OVER_100' END AS issue
 FROM (SELECT *, CASE WHEN b = 1 THEN '서울' WHEN b = 2 THEN '서울>강남' ELSE CASE WHEN b = 25 THEN '부산>' ELSE '서울>' END
   || (['도심', '강남', '영등포신촌', '기타', '외곽'])[b % 5 + 1] || '>' || p_brand END AS region_path FROM f_rent)""")
cte("f_rent_valid", ("f_rent_obs",), """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building, metric, quarter, region_path, floor ORDER BY line) AS rn
 FROM f_rent_obs WHERE issue IS NULL) WHERE rn = 1""")
cte("f_bridge", (), """SELECT p_brand AS place, n, unnest(range(n % 3 + 1)) AS i FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part) WHERE n % 5 <> 0""")


def h(a: str, b: str) -> str:
    return f"CAST((2 * ({a})::HUGEINT + ({b})) // (2 * ({b})) AS BIGINT)"


@query("rent_parse", ["f_rent_obs"], """SELECT line, building, metric, quarter, region_path, region_name, CAST(region_level AS INTEGER) AS region_level, floor,
 CAST(amt AS DOUBLE) / 100000 AS value FROM f_rent_obs WHERE issue IS NULL""")
def rent_parse(t):
    return rent_obs(t).where("issue IS NULL").select("line", "building", "metric", "quarter", "region_path", "region_name",
                                                     "region_level", "floor", F.col("value").cast("double").alias("value"))


@query("rent_quality", ["f_rent_obs"], "SELECT building, coalesce(issue, 'OK') AS outcome, count(*) AS row_count FROM f_rent_obs GROUP BY 1, 2")
def rent_quality(t):
    return rent_obs(t).groupBy("building", F.coalesce("issue", F.lit("OK")).alias("outcome")).agg(F.count(F.lit(1)).alias("row_count"))


@query("rent_units", ["f_rent_obs"], f"""SELECT line, {h('amt', '100')} AS won, {h('amt', '10000')} AS percent_tenths FROM f_rent_obs WHERE issue IS NULL""")
def rent_units(t):
    v = F.col("value")
    return rent_obs(t).where("issue IS NULL").select("line", R.to_won(v).alias("won"), R.to_percent_tenths(v).alias("percent_tenths"))


@query("rent_reference", ["f_rent_obs"], f"""SELECT line, CASE WHEN line % 6 = 0 THEN NULL WHEN line % 2 = 0 THEN {h('amt::HUGEINT * (line % 40 * 10 + 5) * 400', '1000 * 121')}
 ELSE {h('amt::HUGEINT * (line % 40 * 10 + 5)', '1000')} END AS monthly_won FROM f_rent_obs WHERE issue IS NULL""")
def rent_reference(t):
    k = F.col("line")
    area = F.when(k % 12 == 0, F.lit("0")).when(k % 6 == 0, F.lit("about 10")).otherwise(F.concat((k % 40).cast("string"), F.lit(".5")))
    unit = F.when(k % 2 == 0, "PYEONG").otherwise("SQUARE_METERS")
    return rent_obs(t).where("issue IS NULL").select("line", R.monthly_reference(F.col("value"), area, unit).alias("monthly_won"))


@query("region_bridge", ["f_rent_obs", "f_bridge"], """, r AS (SELECT DISTINCT region_path, region_name FROM f_rent_obs WHERE issue IS NULL AND region_level = 3)
SELECT region_path, CAST(11000 + (n * 7 + i) % 25 AS VARCHAR) AS district_code FROM r JOIN f_bridge ON place = region_name
UNION ALL SELECT region_path, 'UNMAPPED' FROM r WHERE region_name NOT IN (SELECT place FROM f_bridge)""")
def region_bridge(t):
    regions = rent_obs(t).where("issue IS NULL").select("region_path").distinct()
    bridge = f_bridge(t)
    return R.link_districts(regions, bridge, ROOT).unionByName(
        R.unmapped_regions(regions, bridge, ROOT).withColumn("district_code", F.lit("UNMAPPED")))


@query("rent_regions", ["f_rent_valid"], f"""SELECT building, region_path, max(region_name) AS region_name, CAST(max(region_level) AS INTEGER) AS region_level,
 max(CASE WHEN metric = 'RENT' AND quarter = '{LATEST}' THEN {h('amt', '100')} END) AS latest_rent_won,
 max(CASE WHEN metric = 'VACANCY_RATE' THEN {h('amt', '10000')} END) AS vacancy_tenths,
 CASE WHEN max(region_level) = 3 THEN string_split(region_path, '>')[2] END AS group_name,
 coalesce(string_agg(CASE WHEN metric = 'FLOOR_RENT' THEN floor || '=' || coalesce(CAST({h('amt', '100')} AS VARCHAR), 'null') END, ','
   ORDER BY list_position(['NONE','B1','1F','2F','3F','4F','5F','6F_PLUS'], floor)), '') AS floors,
 coalesce(string_agg(CASE WHEN metric = 'RENT' THEN quarter || '=' || coalesce(CAST({h('amt', '100')} AS VARCHAR), 'null') END, ',' ORDER BY quarter), '') AS trend
FROM f_rent_valid WHERE metric = 'RENT' OR quarter = '{LATEST}' GROUP BY building, region_path""")
def rent_regions(t):
    r = R.region_benchmarks(rent_valid(t), LATEST)
    def text(c, key):
        return F.array_join(F.transform(c, lambda x: F.concat(x[key], F.lit("="), F.coalesce(x["won"].cast("string"), F.lit("null")))), ",")
    return r.select("building", "region_path", "region_name", "region_level", "latest_rent_won", "vacancy_tenths", "group_name",
                    text("floors", "floor").alias("floors"), text("trend", "quarter").alias("trend"))


@query("custom_order", ["f_rent_obs"], """, r AS (SELECT DISTINCT region_path, region_name, CAST(region_level AS INTEGER) AS level_key,
  CASE region_level WHEN 1 THEN '' WHEN 2 THEN region_name ELSE string_split(region_path, '>')[2] END AS group_key FROM f_rent_obs WHERE issue IS NULL)
SELECT region_path, CAST(CASE WHEN level_key = 1 THEN -1 ELSE coalesce(list_position(['도심', '강남', '영등포신촌', '기타'], group_key) - 1, 4) END AS INTEGER) AS group_rank,
 group_key, level_key, region_name AS name_key FROM r""")
def custom_order(t):
    regions = rent_obs(t).where("issue IS NULL").select("region_path", "region_name", "region_level").distinct()
    keys = R.region_order(F.col("region_level"), F.col("region_name"), R.region_group(F.col("region_path")))
    return regions.select("region_path", *keys).orderBy("group_rank", "group_key", "level_key", "name_key")


# ---------------------------------------------------------------- franchise proxy

LATEST_YEAR = 2000


def _brand_names(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    middle = F.element_at(F.array(F.lit("한식"), F.lit("커피"), F.lit("음료 (커피 외)"), F.lit("치킨")), (F.col("s_nationkey") % 4 + 1))
    return t.supplier.select(
        k.alias("suppkey"), F.col("s_name").alias("brand_name"), F.concat(F.lit("Corp "), (k % 37).cast("string")).alias("corp_name"),
        F.when(F.col("s_nationkey") % 7 == 0, F.lit("도소매")).otherwise(F.lit(FR.FOOD_SERVICE)).alias("industry_large"),
        middle.alias("industry_middle"))


def f_brand(t: Tables) -> DataFrame:
    """Supplier-years of shipped lines as brand-years; lines are reduced before they meet suppliers."""
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("store_count"), F.sum(cents(F.col("l_extendedprice"))).alias("_cents"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("contract_cancel_count"))
    k = F.col("suppkey")
    sales = F.when(k % 9 == 0, F.lit(0)).otherwise(F.floor(F.col("_cents") / F.col("store_count")))
    return per.join(_brand_names(t), "suppkey").select(
        "suppkey", "year", "corp_name", "brand_name", "industry_large", "industry_middle",
        F.when(k % 31 == 0, F.lit(0)).otherwise(F.col("store_count")).alias("store_count"),
        F.when(k % 31 == 0, F.lit(0)).otherwise(F.col("store_count") % 7).alias("new_store_count"),
        F.when(k % 31 == 0, F.lit(0)).otherwise(F.col("contract_cancel_count") % 3).alias("contract_cancel_count"),
        F.lit(0).cast("bigint").alias("contract_end_count"), F.lit(0).cast("bigint").alias("ownership_change_count"),
        F.when((k % 31 == 0) & (F.col("year") % 2 == 0), F.lit(0)).otherwise(sales).cast("bigint").alias("average_sales"))


def f_cost(t: Tables) -> DataFrame:
    b = f_brand(t).where("suppkey % 4 <> 0")
    k = F.col("suppkey")
    extra = b.where("year = 1998").withColumn("year", F.lit(1990))
    rows = b.unionByName(extra)
    zero = k % 13 == 0
    amounts = {"franchise_fee": k * 10, "education_fee": k % 3, "deposit": k % 5 * 100, "other_cost": k % 2, "startup_total": k * 10 + 500}
    return rows.select("suppkey", *FR.YEAR_KEY, *[F.when(zero, F.lit(0)).otherwise(v).cast("bigint").alias(c) for c, v in amounts.items()])


cte("f_brand", (), """SELECT suppkey, year, 'Corp ' || suppkey % 37 AS corp_name, s_name AS brand_name,
 CASE WHEN s_nationkey % 7 = 0 THEN '도소매' ELSE '외식' END AS industry_large, (['한식', '커피', '음료 (커피 외)', '치킨'])[s_nationkey % 4 + 1] AS industry_middle,
 CASE WHEN suppkey % 31 = 0 THEN 0 ELSE n END AS store_count, CASE WHEN suppkey % 31 = 0 THEN 0 ELSE n % 7 END AS new_store_count,
 CASE WHEN suppkey % 31 = 0 THEN 0 ELSE c % 3 END AS contract_cancel_count,
 CAST(CASE WHEN suppkey % 9 = 0 OR (suppkey % 31 = 0 AND year % 2 = 0) THEN 0 ELSE total // n END AS BIGINT) AS average_sales
 FROM (SELECT l_suppkey AS suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2) JOIN supplier ON s_suppkey = suppkey""")
cte("f_scope", ("f_brand",), """SELECT * REPLACE (nullif(average_sales, 0) AS average_sales), CASE WHEN industry_middle = '한식' THEN 'CS100001' ELSE 'CS100010' END AS market_industry
 FROM f_brand WHERE industry_large = '외식' AND industry_middle <> '치킨'""")
cte("f_cost", ("f_brand",), """SELECT suppkey, year, corp_name, brand_name, industry_middle, suppkey % 13 = 0 AS zero FROM
 (SELECT * FROM f_brand WHERE suppkey % 4 <> 0 UNION ALL SELECT * REPLACE (1990 AS year) FROM f_brand WHERE suppkey % 4 <> 0 AND year = 1998)""")


def scope(t: Tables) -> DataFrame:
    return FR.undisclosed_to_null(FR.scope_map(f_brand(t)))


@query("franchise_scope", ["f_brand"], """SELECT year, market_industry, count(*) AS row_count, CAST(sum(store_count) AS BIGINT) AS stores FROM (
 SELECT *, CASE industry_middle WHEN '한식' THEN 'CS100001' WHEN '커피' THEN 'CS100010' WHEN '음료 (커피 외)' THEN 'CS100010' END AS market_industry FROM f_brand
 WHERE industry_large = '외식') WHERE market_industry IS NOT NULL GROUP BY 1, 2""")
def franchise_scope(t):
    return FR.scope_map(f_brand(t)).groupBy("year", "market_industry").agg(F.count(F.lit(1)).alias("row_count"), F.sum("store_count").alias("stores"))


@query("union_years", None, """SELECT quarter_code, stores, CAST(sum(amount) AS BIGINT) AS amount FROM (
 SELECT year(l_shipdate) || '' || quarter(l_shipdate) AS quarter_code, CASE WHEN year(l_shipdate) <= 1998 THEN 'OLD' ELSE 'NEW' END AS stores,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem) GROUP BY 1, 2""")
def union_years(t):
    """Two source generations whose columns carry different names, put together by name."""
    from placemetrics.sources.tabular import union_years as union
    rows = t.lineitem.select("l_shipdate", cents(F.col("l_extendedprice")).alias("price"))
    code = F.concat(F.year("l_shipdate").cast("string"), F.quarter("l_shipdate").cast("string"))
    old = rows.where(F.year("l_shipdate") <= 1998).select(code.alias("STDR_YYQU_CD"), F.col("price").alias("AMT"))
    new = rows.where(F.year("l_shipdate") > 1998).select(F.col("price").alias("SELNG_AMT"), code.alias("YYQU"))
    both = union([(old.withColumn("GEN", F.lit("OLD")), {"STDR_YYQU_CD": "quarter_code", "AMT": "amount", "GEN": "stores"}),
                  (new.withColumn("GEN", F.lit("NEW")), {"YYQU": "quarter_code", "SELNG_AMT": "amount", "GEN": "stores"})])
    return both.groupBy("quarter_code", "stores").agg(F.sum("amount").alias("amount"))


@query("undisclosed", ["f_scope", "f_cost"], """SELECT 'SALES' AS kind, count(*) AS row_count FROM f_scope WHERE store_count > 0 AND average_sales IS NULL
UNION ALL SELECT 'COSTS', count(*) FROM f_cost WHERE zero UNION ALL SELECT 'ZERO_COST_KEPT', count(*) FROM f_cost WHERE NOT zero AND suppkey % 3 = 0""")
def undisclosed(t):
    sales = FR.count_undisclosed(scope(t)).select(F.lit("SALES").alias("kind"), F.col("undisclosed_sales").alias("row_count"))
    c = FR.undisclosed_to_null(f_cost(t), sales=(), costs=FR.COSTS)
    costs = c.agg(F.count(F.when(F.col("startup_total").isNull() & F.col("deposit").isNull(), 1)).alias("a"),
                  F.count(F.when(F.col("education_fee") == 0, 1)).alias("b"))
    return sales.unionByName(costs.select(F.lit("COSTS").alias("kind"), F.col("a").alias("row_count"))).unionByName(
        costs.select(F.lit("ZERO_COST_KEPT").alias("kind"), F.col("b").alias("row_count")))


@query("optional_enrich", ["f_scope", "f_cost"], """
, j AS (SELECT s.suppkey AS sk, c.suppkey AS ck FROM f_scope s FULL JOIN f_cost c USING (year, corp_name, brand_name, industry_middle))
SELECT count(*) FILTER (sk IS NOT NULL AND ck IS NOT NULL) AS matched, count(*) FILTER (sk IS NULL) AS unmatched,
 count(*) FILTER (sk IS NOT NULL AND ck IS NULL) AS without_costs FROM j""")
def optional_enrich(t):
    stores, costs = scope(t), f_cost(t)
    missing = FR.join_costs(stores, costs).agg(F.count(F.when(~F.col("has_costs"), 1)).alias("without_costs"))
    return FR.cost_join_counts(stores, costs).crossJoin(missing)      # two one-row tables


@query("brand_years", ["f_scope"], f"""SELECT suppkey, year, year - 1 AS performance_year,
 store_count > 0 OR new_store_count > 0 OR contract_cancel_count > 0 OR average_sales IS NOT NULL AS status_reported,
 average_sales * 1000 AS average_sales_won, {h('average_sales * 1000', '12')} AS monthly_sales_won FROM f_scope""")
def brand_years(t):
    return FR.year_stats(scope(t)).select("suppkey", "year", "performance_year", "status_reported", "average_sales_won", "monthly_sales_won")


@query("top_brands", ["f_scope"], f"""SELECT market_industry, position, brand_name, store_count, total_matches FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY market_industry ORDER BY store_count DESC, brand_name, corp_name) AS INTEGER) AS position,
  count(*) OVER (PARTITION BY market_industry) AS total_matches FROM f_scope WHERE year = {LATEST_YEAR}) WHERE position <= 10""")
def top_brands(t):
    return FR.top_brands(scope(t).where(F.col("year") == LATEST_YEAR), 10).select(
        "market_industry", "position", "brand_name", "store_count", "total_matches")


@query("brand_summary", ["f_scope"], f"""SELECT market_industry, count(*) AS brand_count, count(*) FILTER (store_count > 0) AS brands_with_stores,
 count(average_sales) AS brands_with_sales FROM f_scope WHERE year = {LATEST_YEAR} GROUP BY 1""")
def brand_summary(t):
    return FR.brand_summary(scope(t).where(F.col("year") == LATEST_YEAR))


@query("brand_history", ["f_scope"], f"""SELECT suppkey, year, store_count, CAST(row_number() OVER (PARTITION BY suppkey ORDER BY year) AS INTEGER) AS position FROM f_scope
WHERE suppkey IN (SELECT suppkey FROM f_scope WHERE year = {LATEST_YEAR} AND store_count >= 60)""".replace("60", "8"))
def brand_history(t):
    rows = scope(t)
    return FR.with_history(rows, rows.where("store_count >= 8"), LATEST_YEAR).select("suppkey", "year", "store_count", "position")


@query("brand_search", None, """SELECT query, s_suppkey AS suppkey FROM supplier CROSS JOIN (SELECT n_nationkey || '' AS query FROM nation UNION SELECT lower(r_name) FROM region
 UNION SELECT 'CORP ' || n_nationkey FROM nation) q WHERE contains(lower(s_name), lower(query)) OR contains('corp ' || s_suppkey % 37, lower(query))""")
def brand_search(t):
    req = (t.nation.select(F.col("n_nationkey").cast("string").alias("query"))
           .unionByName(t.region.select(F.lower("r_name").alias("query")))
           .unionByName(t.nation.select(F.concat(F.lit("CORP "), F.col("n_nationkey").cast("string")).alias("query"))).distinct())
    return FR.search_many(_brand_names(t), req, "suppkey")


# ---------------------------------------------------------------- directory proxy

def f_biz(t: Tables) -> DataFrame:
    """Customers as directory rows; blanks at fixed residues."""
    k = F.col("c_custkey")
    no = X.industry_no(F.col("c_mktsegment"))
    names = F.array(*[F.lit(x) for x in ("돼지고기 구이", "백반", "곱창 전골", "카페", "국수", "분식", "족발/보쌈", "죽", "찻집", "해산물", "면 요리", "빵")])
    base = t.customer.select(
        k.alias("custkey"), F.when(k % 103 == 0, F.lit(" ")).otherwise(k.cast("string")).alias("business_id"),
        F.when(k % 101 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("c_name"))).alias("business_name"),
        F.when(k % 90 == 7, F.lit(B.COFFEE_CODE)).otherwise(F.concat(F.lit("I2"), no.cast("string"), F.lpad((k % 12).cast("string"), 2, "0"))).alias("small_code"),
        F.element_at(names, (k % 12 + 1).cast("int")).alias("small_name"),
        F.concat(F.lit("I2"), no.cast("string")).alias("middle_code"),
        F.when(no <= 3, F.lit("한식 음식점")).otherwise(F.lit("기타 음식점")).alias("middle_name"),
        (F.col("c_nationkey") + 11000).cast("string").alias("district_code"),
        F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("district_name"),
        F.when(k % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("B"), (k % 5).cast("string"))).alias("branch_name"))
    return base.withColumn("market_industry", B.map_category(F.col("middle_name"), F.col("small_code"), F.col("small_name")))


cte("f_biz", ("f_segment",), """SELECT *, CASE WHEN small_code = 'I21201' OR small_name LIKE '%카페%' THEN 'CS100010' WHEN middle_name LIKE '%한식%' THEN 'CS100001' END AS market_industry FROM (
 SELECT c_custkey AS custkey, CASE WHEN c_custkey % 103 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS business_id,
  CASE WHEN c_custkey % 101 = 0 THEN '' ELSE c_name END AS business_name,
  CASE WHEN c_custkey % 90 = 7 THEN 'I21201' ELSE 'I2' || industry_no || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0') END AS small_code,
  (['돼지고기 구이', '백반', '곱창 전골', '카페', '국수', '분식', '족발/보쌈', '죽', '찻집', '해산물', '면 요리', '빵'])[c_custkey % 12 + 1] AS small_name,
  'I2' || industry_no AS middle_code, CASE WHEN industry_no <= 3 THEN '한식 음식점' ELSE '기타 음식점' END AS middle_name,
  CAST(11000 + c_nationkey AS VARCHAR) AS district_code, CASE WHEN c_custkey % 97 = 0 THEN '' ELSE 'NATION_' || c_nationkey END AS district_name,
  CASE WHEN c_custkey % 3 <> 0 THEN 'B' || c_custkey % 5 END AS branch_name FROM customer JOIN f_segment ON segment = c_mktsegment)""")
cte("f_biz_ok", ("f_biz",), "SELECT * FROM f_biz WHERE business_id <> '' AND business_name <> '' AND district_name <> ''")


def biz_ok(t: Tables) -> DataFrame:
    ok, _ = D.split_by_issues(B.validate_directory(f_biz(t), ["branch_name"]))
    return ok


@query("directory_quality", ["f_biz"], """SELECT outcome, branch, count(*) AS row_count FROM (SELECT unnest(list_filter([
 CASE WHEN business_id = '' THEN 'MISSING_BUSINESS_ID' END, CASE WHEN business_name = '' THEN 'MISSING_BUSINESS_NAME' END,
 CASE WHEN district_name = '' THEN 'MISSING_DISTRICT_NAME' END, CASE WHEN business_id <> '' AND business_name <> '' AND district_name <> '' THEN 'OK' END],
 lambda x: x IS NOT NULL)) AS outcome, branch_name AS branch FROM f_biz) GROUP BY 1, 2""")
def directory_quality(t):
    v = B.validate_directory(f_biz(t), ["branch_name"])
    codes = F.when(F.size("issues") == 0, F.array(F.lit("OK"))).otherwise(F.col("issues"))
    return v.select(F.explode(codes).alias("outcome"), F.col("branch_name").alias("branch")).groupBy("outcome", "branch").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("category_map", ["f_biz"], "SELECT small_code, small_name, middle_name, market_industry, count(*) AS row_count FROM f_biz GROUP BY ALL")
def category_map(t):
    return f_biz(t).groupBy("small_code", "small_name", "middle_name", "market_industry").agg(F.count(F.lit(1)).alias("row_count"))


@query("category_counts", ["f_biz_ok"], """SELECT small_code, small_name, middle_code, middle_name, market_industry, count(*) AS business_count,
 regexp_matches(small_name, '소고기|돼지고기|닭/오리|곱창|족발|보쌈|육류|고기') AS meat_category FROM f_biz_ok WHERE market_industry IS NOT NULL GROUP BY ALL""")
def category_counts(t):
    return B.category_counts(biz_ok(t))


@query("competition_topn", ["f_biz_ok"], """SELECT district_code, small_code, business_name, business_id, position, business_count, business_count > 3 AS truncated FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY district_code, small_code ORDER BY business_name, business_id) AS INTEGER) AS position,
  count(*) OVER (PARTITION BY district_code, small_code) AS business_count FROM f_biz_ok WHERE market_industry IS NOT NULL) WHERE position <= 3""")
def competition_topn(t):
    return B.competition(biz_ok(t), 3)


@query("profile_resolve", ["f_biz_ok"], """
, ind AS (SELECT * FROM (VALUES ('CS100001', 'Korean', TRUE), ('CS100010', 'Coffee', TRUE), ('CS100002', 'Other', FALSE)) v(industry_code, industry_name, supported)),
det AS (SELECT small_code, market_industry, min(small_name) AS detail_name FROM f_biz_ok WHERE market_industry IS NOT NULL GROUP BY 1, 2),
p AS (SELECT c_custkey, (['CS100001', 'CS100010', 'CS100002', 'CS999999'])[c_custkey % 4 + 1] AS industry_code,
  CASE WHEN c_custkey % 5 <> 0 THEN 'I2' || (c_custkey % 5 + 1) || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0') END AS detail_code FROM customer)
SELECT c_custkey, outcome, CASE WHEN outcome = 'OK' THEN industry_name END AS industry_name, CASE WHEN outcome = 'OK' THEN detail_name END AS detail_name,
 CASE WHEN outcome = 'OK' THEN 'm1' END AS market_release, CASE WHEN outcome = 'OK' AND detail_name IS NOT NULL THEN 'd1' END AS directory_release FROM (
 SELECT p.*, industry_name, detail_name, CASE WHEN NOT coalesce(supported, FALSE) THEN 'INDUSTRY_NOT_FOUND'
  WHEN detail_code IS NOT NULL AND detail_name IS NULL THEN 'DETAIL_MISMATCH' ELSE 'OK' END AS outcome
 FROM p LEFT JOIN ind USING (industry_code) LEFT JOIN det ON det.small_code = p.detail_code AND det.market_industry = p.industry_code)""")
def profile_resolve(t):
    k = F.col("c_custkey")
    prof = t.customer.select(
        "c_custkey", F.element_at(F.array(*[F.lit(x) for x in ("CS100001", "CS100010", "CS100002", "CS999999")]), (k % 4 + 1).cast("int")).alias("industry_code"),
        F.when(k % 5 != 0, F.concat(F.lit("I2"), (k % 5 + 1).cast("string"), F.lpad((k % 12).cast("string"), 2, "0"))).alias("detail_code"))
    ind = constant_rows(t.spark, industry_code=["CS100001", "CS100010", "CS100002"], industry_name=["Korean", "Coffee", "Other"],
                        supported=[True, True, False])
    return B.resolve_profiles(prof, ind, biz_ok(t), "m1", "d1").drop("industry_code", "detail_code")
