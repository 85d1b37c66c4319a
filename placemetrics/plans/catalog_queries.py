"""Registered catalog queries: parts as products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.hashing import canonical_json, multiset_fingerprint
from placemetrics.operators import catalog as C
from placemetrics.plans.proxies import Tables
from placemetrics.plans.sqlbase import cte, sql

QUERIES, ORACLE = {}, {}
BASIS = "2024-06-01"


def query(name: str, needs=None, body: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(needs, body) if needs else body
        return fn
    return add


SUBJECTS = ("IDENTITY", "APPLICATION_PERIOD", "BUSINESS_STAGE", "ELIGIBILITY_CONDITION", "FINANCIAL_CONDITION", "REGION", "PURPOSE", "INDUSTRY")
METHODS = ("OFFICIAL_WEB_PAGE", "OFFICIAL_ATTACHMENT", "OFFICIAL_API", "SEARCH_RESULT_SUMMARY")
KINDS = ("GRANT", "GUARANTEE", "LOAN", "LOAN", "PROGRAM", "UNKNOWN")
REPAY = ("EQUAL_INSTALLMENT", "EQUAL_PRINCIPAL", "NOT_APPLICABLE", "UNKNOWN", "BULLET")


def f_product(t: Tables) -> DataFrame:
    """One product per part; every rule is broken at some residue of the key."""
    k = F.col("p_partkey")
    i32 = lambda c: c.cast("int")

    def pick(options, idx):
        return F.get(F.array(*[F.lit(o) for o in options]), i32(idx))

    def opt(cond, value):
        return F.when(cond, value)

    basis = F.lit(BASIS).cast("date")
    evidence = F.transform(F.sequence(F.lit(0), i32(k % 5)), lambda i: F.struct(
        F.concat(F.lit("e"), (i % 4).cast("string")).alias("id"), F.get(F.array(*[F.lit(s) for s in SUBJECTS]), i32((k + i * 3) % 8)).alias("subject"),
        F.get(F.array(*[F.lit(m) for m in METHODS]), i32((k + i) % 4)).alias("method"),
        F.date_add(basis, i32(k % 50) - 45 + i).alias("observed_at"), F.when((k + i) % 3 != 0, F.lit("c")).alias("checksum")))

    def codes(m, a, b):
        return F.when(k % m == 0, F.array(*[F.lit(x) for x in a])).when(k % m == 1, F.array(*[F.lit(x) for x in b])).otherwise(F.array().cast("array<string>"))

    origin = F.when(k % 3 == 0, "OPERATOR").otherwise("SYNC")
    return t.spread("part").select(
        F.concat(F.lit("p-"), k.cast("string")).alias("product_key"), F.concat(F.lit("1."), (k % 3).cast("string"), F.lit("."), (k % 7).cast("string")).alias("version"),
        k.alias("line"), F.col("p_name").alias("name"), origin.alias("origin"), F.when(k % 2 == 0, "SEMAS_OLS").otherwise("BIZINFO").alias("source"),
        opt(k % 13 != 0, F.concat(F.lit("x"), (k % 1500).cast("string"))).alias("external_id"),
        pick(KINDS, k % 6).alias("support_type"), codes(4, ["PRE_REGISTRATION"], ["PRE_REGISTRATION", "POST_REGISTRATION"]).alias("stages"),
        F.struct(pick(("NATIONWIDE", "SEOUL", "DISTRICTS", "UNKNOWN"), F.col("p_size") % 4).alias("scope"), codes(5, ["11010"], ["11020", "11030"]).alias("district_codes")).alias("region"),
        F.struct(codes(6, ["RND"], ["OTHER", "RND"]).alias("included"), codes(7, ["RND"], ["OTHER"]).alias("excluded")).alias("purpose"),
        F.struct(pick(("UNRESTRICTED", "LISTED", "UNKNOWN"), k % 3).alias("scope"), codes(8, ["CS100001"], ["CS100010"]).alias("included"), codes(9, ["CS100001"], ["CS100002"]).alias("excluded")).alias("industry"),
        F.struct(opt(k % 10 != 0, F.date_add(basis, i32(k % 80) - 60)).alias("start"), opt(k % 5 != 0, F.date_add(basis, i32(k % 70) - 40)).alias("end"), opt(k % 4 == 0, F.lit("note")).alias("note")).alias("period"),
        pick(("OPEN", "CLOSED", "UNKNOWN"), k % 3).alias("status"), F.date_add(basis, i32(k % 33) - 30).alias("observed_at"),
        (k % 2 == 0).alias("retrieved"), opt(k % 3 != 0, F.lit("abc")).alias("checksum"), opt(k % 4 != 0, k * 1000).alias("public_limit"),
        opt(k % 7 < 4, F.lit("fixed")).alias("interest_condition"), (k % 5 < 3).alias("interest_confirmed"), opt(k % 4 < 3, (k % 9).cast("double")).alias("interest_rate"),
        opt(k % 8 < 3, F.lit("monthly")).alias("repayment_condition"), pick(REPAY, k % 5).alias("repayment_method"),
        opt(k % 6 < 4, i32(k % 48) + 1).alias("term_months"), opt(k % 9 < 6, i32(k % 30)).alias("grace_months"), codes(11, ["why"], ["why", "also"]).alias("unsupported_reasons"),
        evidence.alias("evidence"))


_B = f"DATE '{BASIS}'"
_A = "list_value()::VARCHAR[]"


def _codes(m: int, a: str, b: str) -> str:
    return f"CASE WHEN k % {m} = 0 THEN {a}::VARCHAR[] WHEN k % {m} = 1 THEN {b}::VARCHAR[] ELSE [] END"


cte("f_product", (), f"""SELECT k, 'p-' || k AS product_key, '1.' || k % 3 || '.' || k % 7 AS version, p_name AS name, CASE WHEN k % 3 = 0 THEN 'OPERATOR' ELSE 'SYNC' END AS origin,
 CASE WHEN k % 2 = 0 THEN 'SEMAS_OLS' ELSE 'BIZINFO' END AS source, CASE WHEN k % 13 <> 0 THEN 'x' || k % 1500 END AS external_id,
 (['GRANT','GUARANTEE','LOAN','LOAN','PROGRAM','UNKNOWN'])[k % 6 + 1] AS kind, {_codes(4, "['PRE_REGISTRATION']", "['PRE_REGISTRATION','POST_REGISTRATION']")} AS stages,
 (['NATIONWIDE','SEOUL','DISTRICTS','UNKNOWN'])[p_size % 4 + 1] AS rscope, {_codes(5, "['11010']", "['11020','11030']")} AS dcodes,
 {_codes(6, "['RND']", "['OTHER','RND']")} AS pinc, {_codes(7, "['RND']", "['OTHER']")} AS pexc, (['UNRESTRICTED','LISTED','UNKNOWN'])[k % 3 + 1] AS iscope,
 {_codes(8, "['CS100001']", "['CS100010']")} AS iinc, {_codes(9, "['CS100001']", "['CS100002']")} AS iexc,
 CASE WHEN k % 10 <> 0 THEN {_B} + CAST(k % 80 - 60 AS INTEGER) END AS ps, CASE WHEN k % 5 <> 0 THEN {_B} + CAST(k % 70 - 40 AS INTEGER) END AS pe, CASE WHEN k % 4 = 0 THEN 'note' END AS note,
 (['OPEN','CLOSED','UNKNOWN'])[k % 3 + 1] AS status, {_B} + CAST(k % 33 - 30 AS INTEGER) AS seen, k % 2 = 0 AS retrieved, k % 3 <> 0 AS has_sum, CASE WHEN k % 4 <> 0 THEN k * 1000 END AS lim,
 k % 7 < 4 AS icond, k % 5 < 3 AS iconf, k % 4 < 3 AS has_rate, k % 8 < 3 AS rcond, (['EQUAL_INSTALLMENT','EQUAL_PRINCIPAL','NOT_APPLICABLE','UNKNOWN','BULLET'])[k % 5 + 1] AS meth,
 CASE WHEN k % 6 < 4 THEN k % 48 + 1 END AS term, CASE WHEN k % 9 < 6 THEN k % 30 END AS grace, CASE WHEN k % 11 = 0 THEN 1 WHEN k % 11 = 1 THEN 2 ELSE 0 END AS n_unsup
 FROM (SELECT p_partkey AS k, p_name, p_size FROM part)""")
cte("f_evid", ("f_product",), f"""SELECT k, origin, i, 'e' || i % 4 AS id, (['IDENTITY','APPLICATION_PERIOD','BUSINESS_STAGE','ELIGIBILITY_CONDITION','FINANCIAL_CONDITION','REGION','PURPOSE','INDUSTRY'])[(k + i * 3) % 8 + 1] AS subject,
 (['OFFICIAL_WEB_PAGE','OFFICIAL_ATTACHMENT','OFFICIAL_API','SEARCH_RESULT_SUMMARY'])[(k + i) % 4 + 1] AS method, {_B} + CAST(k % 50 - 45 + i AS INTEGER) AS seen, (k + i) % 3 <> 0 AS has_sum
 FROM (SELECT k, origin, unnest(range(k % 5 + 1)) AS i FROM f_product)""")
cte("f_need", ("f_product",), """SELECT k, 'IDENTITY' AS subject FROM f_product UNION ALL SELECT k, 'APPLICATION_PERIOD' FROM f_product
 UNION ALL SELECT k, 'BUSINESS_STAGE' FROM f_product WHERE len(stages) > 0 UNION ALL SELECT k, 'FINANCIAL_CONDITION' FROM f_product WHERE kind IN ('LOAN', 'GUARANTEE')
 UNION ALL SELECT k, 'REGION' FROM f_product WHERE rscope <> 'UNKNOWN' UNION ALL SELECT k, 'PURPOSE' FROM f_product WHERE len(pinc) > 0 OR len(pexc) > 0
 UNION ALL SELECT k, 'INDUSTRY' FROM f_product WHERE iscope <> 'UNKNOWN'""")
cte("f_reason", ("f_product",), """SELECT k, n_unsup, CASE WHEN kind <> 'LOAN' THEN ['NOT_A_LOAN'] ELSE list_filter([CASE WHEN lim IS NULL THEN 'NO_PUBLIC_LIMIT' END,
 CASE WHEN NOT iconf OR NOT has_rate THEN 'RATE_NOT_CONFIRMED' END, CASE WHEN meth NOT IN ('EQUAL_INSTALLMENT', 'EQUAL_PRINCIPAL') THEN 'METHOD_NOT_SUPPORTED' END,
 CASE WHEN term IS NULL OR grace IS NULL THEN 'TERM_UNKNOWN' END], lambda x: x IS NOT NULL) END AS reasons FROM f_product""")
_MONEY = "SUPPORT_TYPE_FINANCIAL_CONTRADICTION"
_RULES = [
    ("CHECKSUM_MISSING", "retrieved AND NOT has_sum"), ("CHECKSUM_NOT_RETRIEVED", "NOT retrieved AND has_sum"), ("APPLICATION_PERIOD_CONTRADICTION", "pe < ps"),
    ("APPLICATION_PERIOD_NOTE_MISSING", "ps IS NULL AND pe IS NULL AND note IS NULL"), ("OBSERVED_OPEN_AFTER_PERIOD_END", "status = 'OPEN' AND pe < seen"),
    ("OBSERVED_OPEN_BEFORE_PERIOD_START", "status = 'OPEN' AND seen < ps"), ("CLOSED_BEFORE_PERIOD_END", "status = 'CLOSED' AND pe > seen"),
    ("OBSERVED_AT_AFTER_BASIS_DATE", f"seen > {_B}"), ("REGION_DISTRICT_CONTRADICTION", "rscope <> 'DISTRICTS' AND len(dcodes) > 0"),
    ("REGION_DISTRICTS_MISSING", "rscope = 'DISTRICTS' AND len(dcodes) = 0"),
    ("INDUSTRY_SCOPE_CONTRADICTION", "(iscope = 'UNRESTRICTED' AND len(iinc) + len(iexc) > 0) OR (iscope = 'LISTED' AND len(iinc) + len(iexc) = 0)"),
    ("INDUSTRY_INCLUDE_EXCLUDE_CONFLICT", "len(list_intersect(iinc, iexc)) > 0"), ("PURPOSE_INCLUDE_EXCLUDE_CONFLICT", "len(list_intersect(pinc, pexc)) > 0"),
    (_MONEY, "kind = 'UNKNOWN' AND meth <> 'UNKNOWN'"), (_MONEY, "kind = 'UNKNOWN' AND (iconf OR has_rate OR term IS NOT NULL OR grace IS NOT NULL)"),
    (_MONEY, "kind NOT IN ('UNKNOWN', 'LOAN') AND (icond OR rcond)"), (_MONEY, "kind NOT IN ('UNKNOWN', 'LOAN') AND meth <> 'NOT_APPLICABLE'"),
    (_MONEY, "kind NOT IN ('UNKNOWN', 'LOAN') AND iconf"), (_MONEY, "kind NOT IN ('UNKNOWN', 'LOAN') AND (has_rate OR term IS NOT NULL OR grace IS NOT NULL)"),
    (_MONEY, "kind = 'LOAN' AND meth = 'NOT_APPLICABLE'"), ("INTEREST_CONFIRMED_WITHOUT_CONDITION", "iconf AND NOT icond"), ("INTEREST_RATE_NOT_CONFIRMED", "NOT iconf AND has_rate"),
    ("REPAYMENT_PERIOD_CONTRADICTION", "grace >= term"), ("SYNCED_PRODUCT_WITHOUT_SOURCE", "origin = 'SYNC' AND external_id IS NULL")]
cte("f_issue", ("f_product", "f_evid", "f_need", "f_reason"), " UNION ALL ".join(f"SELECT k, '{c}' AS code FROM f_product WHERE {w}" for c, w in _RULES) + f"""
 UNION ALL SELECT k, 'CALCULATION_REASON_MISSING' FROM f_reason WHERE len(reasons) > 0 AND n_unsup = 0 UNION ALL SELECT k, 'CALCULATION_REASON_UNEXPECTED' FROM f_reason WHERE len(reasons) = 0 AND n_unsup > 0
 UNION ALL SELECT k, 'MISSING_EVIDENCE' FROM f_need n WHERE NOT EXISTS (SELECT 1 FROM f_evid e WHERE e.k = n.k AND e.subject = n.subject)
 UNION ALL SELECT k, 'DUPLICATE_EVIDENCE_ID' FROM (SELECT k, id, count(*) AS n FROM f_evid GROUP BY 1, 2) x, range(n - 1) WHERE n > 1
 UNION ALL SELECT k, 'EVIDENCE_OBSERVED_AT_AFTER_BASIS_DATE' FROM f_evid WHERE seen > {_B}
 UNION ALL SELECT k, 'EVIDENCE_CHECKSUM_NOT_APPLICABLE' FROM f_evid WHERE has_sum AND (method = 'SEARCH_RESULT_SUMMARY' OR (method = 'OFFICIAL_WEB_PAGE' AND origin <> 'SYNC'))
 UNION ALL SELECT k, 'EVIDENCE_CHECKSUM_MISSING' FROM f_evid WHERE NOT has_sum AND method IN ('OFFICIAL_ATTACHMENT', 'OFFICIAL_API')
 UNION ALL SELECT k, 'EVIDENCE_NOT_PRIMARY' FROM f_evid WHERE method = 'SEARCH_RESULT_SUMMARY'""")


@query("catalog_rules", ["f_issue"], """SELECT code, CASE WHEN code IN ('EVIDENCE_NOT_PRIMARY', 'CLOSED_BEFORE_PERIOD_END') THEN 'WARNING' ELSE 'ERROR' END AS severity,
 count(*) AS issue_count, count(DISTINCT k) AS products FROM f_issue GROUP BY 1, 2""")
def catalog_rules(t):
    per = C.validate_products(f_product(t), BASIS).groupBy("code", "severity", "product_key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("code", "severity").agg(F.sum("n").alias("issue_count"), F.count(F.lit(1)).alias("products"))


@query("category_checks", ["f_issue"], """, x AS (SELECT *, code IN ('EVIDENCE_NOT_PRIMARY', 'CLOSED_BEFORE_PERIOD_END') AS w, CASE
  WHEN code LIKE 'DUPLICATE%' THEN 'duplicates' WHEN code LIKE '%CHECKSUM%' THEN 'checksum' WHEN code LIKE 'CALCULATION%' THEN 'calculation'
  WHEN code IN ('MISSING_EVIDENCE', 'EVIDENCE_NOT_PRIMARY', 'EVIDENCE_OBSERVED_AT_AFTER_BASIS_DATE', 'SYNCED_PRODUCT_WITHOUT_SOURCE') THEN 'evidence'
  WHEN code IN ('APPLICATION_PERIOD_CONTRADICTION', 'APPLICATION_PERIOD_NOTE_MISSING', 'OBSERVED_OPEN_AFTER_PERIOD_END', 'OBSERVED_OPEN_BEFORE_PERIOD_START', 'OBSERVED_AT_AFTER_BASIS_DATE', 'CLOSED_BEFORE_PERIOD_END') THEN 'dates'
  ELSE 'support' END AS category FROM f_issue)
SELECT c.category, CASE WHEN count(*) FILTER (NOT w) > 0 THEN 'FAIL' WHEN count(*) FILTER (w) > 0 THEN 'WARN' ELSE 'PASS' END AS outcome,
 CASE WHEN count(*) FILTER (NOT w) > 0 THEN count(*) FILTER (NOT w) ELSE count(*) FILTER (w) END AS issue_count,
 'p-' || min(k) FILTER (NOT w) AS example_product FROM (VALUES ('schema'), ('duplicates'), ('evidence'), ('dates'), ('support'), ('checksum'), ('calculation')) c(category)
LEFT JOIN x USING (category) GROUP BY 1""")
def category_checks(t):
    return C.category_checks(C.validate_products(f_product(t), BASIS)).drop("example_code")


@query("required_evidence", ["f_need", "f_evid"], """SELECT 'p-' || p.k AS product_key, coalesce(string_agg(n.subject, ',' ORDER BY n.subject), '') AS missing FROM f_product p
 LEFT JOIN f_need n ON n.k = p.k AND NOT EXISTS (SELECT 1 FROM f_evid e WHERE e.k = n.k AND e.subject = n.subject) GROUP BY 1""")
def required_evidence(t):
    return f_product(t).select("product_key", F.array_join(F.array_sort(C.missing_evidence()), ",").alias("missing"))


@query("calc_reasons", ["f_reason"], "SELECT 'p-' || k AS product_key, array_to_string(reasons, ',') AS reasons FROM f_reason")
def calc_reasons(t):
    return f_product(t).select("product_key", F.array_join(C.calculation_reasons(), ",").alias("reasons"))


@query("array_overlap", ["f_product"], """SELECT product_key, array_to_string(list_sort(list_intersect(pinc, pexc)), ',') AS purposes, array_to_string(list_sort(list_intersect(iinc, iexc)), ',') AS industries FROM f_product""")
def array_overlap(t):
    return f_product(t).select("product_key", F.array_join(F.array_sort(C.overlap(F.col("purpose.included"), F.col("purpose.excluded"))), ",").alias("purposes"),
                               F.array_join(F.array_sort(C.overlap(F.col("industry.included"), F.col("industry.excluded"))), ",").alias("industries"))


@query("duplicate_products", ["f_product"], """SELECT 'DUPLICATE_PRODUCT_VERSION' AS code, CAST(sum(n - 1) AS BIGINT) AS issue_count FROM (SELECT k % 1800, count(*) AS n FROM f_product GROUP BY 1)
UNION ALL SELECT 'DUPLICATE_SOURCE_REF', CAST(sum(n - 1) AS BIGINT) FROM (SELECT source, external_id, count(*) AS n FROM f_product WHERE external_id IS NOT NULL GROUP BY 1, 2)""")
def duplicate_products(t):
    p = f_product(t).withColumns({"product_key": (F.col("line") % 1800).cast("string"), "version": F.lit("1.0.0")})
    return C.duplicate_products(p)


# ---------------------------------------------------------------- versions

def _stored(t: Tables, part: DataFrame | None = None) -> DataFrame:
    """Stored versions: one to three per product, some malformed; content differs at every tenth key."""
    k = F.col("p_partkey")
    base = (t.part if part is None else part).where(k % 17 != 0).select(k.alias("k"), F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))).alias("i"))
    ver = F.when((F.col("k") % 5 == 0) & (F.col("i") == 1), F.lit("1.x.2")).when((F.col("k") % 23 == 0), F.lit("v1")).otherwise(
        F.concat(F.lit("1."), (F.col("i") * 5).cast("string"), F.lit("."), (F.col("k") % 12).cast("string")))
    fp = F.when((F.col("k") % 10 != 0) & (F.col("i") == 0), F.sha2(F.col("k").cast("string"), 256)).otherwise(
        F.sha2(F.concat(F.lit("old"), F.col("k").cast("string"), F.col("i").cast("string")), 256))
    return base.select(F.concat(F.lit("p-"), F.col("k").cast("string")).alias("product_key"), ver.alias("version"), fp.alias("fingerprint"), F.col("i").alias("line"))


def _current(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return t.part.select(F.concat(F.lit("p-"), k).alias("product_key"), F.sha2(k, 256).alias("fingerprint"))


cte("f_stored", (), """SELECT 'p-' || k AS product_key, k, i, CASE WHEN k % 5 = 0 AND i = 1 THEN '1.x.2' WHEN k % 23 = 0 THEN 'v1' ELSE '1.' || i * 5 || '.' || k % 12 END AS version,
 i * 5 AS minor, k % 12 AS patch, NOT (k % 5 = 0 AND i = 1) AND k % 23 <> 0 AS ok, k % 10 <> 0 AND i = 0 AS same FROM (SELECT p_partkey AS k, unnest(range(p_partkey % 3 + 1)) AS i FROM part WHERE p_partkey % 17 <> 0)""")


@query("next_version", ["f_stored"], """SELECT product_key, coalesce('1.' || max(minor) FILTER (ok) || '.' || max(patch) FILTER (ok) + 1, '1.0.0') AS next_version FROM f_stored GROUP BY 1""".replace("max(patch) FILTER (ok) + 1", "(max(patch) FILTER (ok) + 1)"))
def next_version(t):
    return C.next_patch(_stored(t))


@query("assign_version", ["f_stored"], """, n AS (SELECT product_key, coalesce('1.' || max(minor) FILTER (ok) || '.' || (max(patch) FILTER (ok) + 1), '1.0.0') AS nv, max(version) FILTER (same) AS sv FROM f_stored GROUP BY 1)
SELECT 'p-' || p_partkey AS product_key, coalesce(sv, nv, '1.0.0') AS assigned_version, sv IS NOT NULL AS reused FROM part LEFT JOIN n ON n.product_key = 'p-' || p_partkey""")
def assign_version(t):
    return C.assign_versions(_current(t), _stored(t, t.dealt("part", "p_partkey"))).select("product_key", "assigned_version", "reused")


@query("immutability", ["f_stored"], """SELECT product_key, version FROM f_stored WHERE i = 0 AND NOT same""")
def immutability(t):
    stored = _stored(t)
    current = _current(t).join(stored.where("line = 0").select("product_key", "version"), "product_key")
    return C.check_immutable(current, stored.where("line = 0"))


@query("next_daily", None, """SELECT day, lang, day || '.' || (greatest(max(CASE WHEN n BETWEEN 0 AND 899 THEN n END), 0, 2 * CAST(lang = 'en' AS INTEGER)) + 1) AS next_version FROM (
 SELECT lang, CAST(DATE '2024-01-01' + CAST(doc_id % 9 AS INTEGER) AS VARCHAR) AS day, doc_id % 31 AS n FROM documents) GROUP BY 1, 2""")
def next_daily(t):
    k = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 9).cast("int")).cast("string")
    d = t.documents.select("lang", day.alias("d"), F.when(k % 7 == 0, F.concat(day, F.lit(".x"))).otherwise(F.concat(day, F.lit("."), (k % 31).cast("string"))).alias("version"))
    both = d.unionByName(d.where(F.col("version").endswith(".x")).withColumn("version", F.col("version"))).unionByName(
        t.documents.where(k % 7 == 0).select("lang", day.alias("d"), F.concat(day, F.lit("."), (k % 31).cast("string")).alias("version")))
    manual = F.when(F.col("lang") == "en", F.concat(F.col("d"), F.lit(".2"))).otherwise(F.lit("2020-01-01.99"))
    return C.next_daily(both, F.col("d"), "lang", manual)


@query("canonical_json")
def canonical_json_query(t):
    p = f_product(t)
    dtype = p.schema
    return p.select("product_key", canonical_json(F.struct(*[F.col(c) for c in p.columns]), dtype).alias("json"))


@query("content_fp")
def content_fp(t):
    """Fingerprints stay equal when only volatile fields change, and differ when a name changes."""
    p = f_product(t)
    touched = p.withColumns({"version": F.lit("9.9.9"), "observed_at": F.date_add("observed_at", 1)})
    renamed = p.withColumn("name", F.concat("name", F.lit("!")))
    a, b, c = (C.content_fingerprint(x).select("product_key", F.col("fingerprint").alias(n)) for x, n in ((p, "a"), (touched, "b"), (renamed, "c")))
    return a.join(b, "product_key").join(c, "product_key").select("product_key", (F.col("a") == F.col("b")).alias("stable"), (F.col("a") != F.col("c")).alias("sensitive"))


_W = " || '/' || ".join(f"CAST(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT::HUGEINT) AS VARCHAR)" for i in range(8))


@query("release_fp", None, f"""SELECT quarter_code, CAST(sum(c) AS BIGINT) AS row_count, sha256({_W} || '/' || CAST(sum(c) AS VARCHAR)) AS fingerprint FROM (
 SELECT quarter_code, c, sha256(r || 'x' || c) AS h FROM (SELECT quarter_code, r, count(*) AS c FROM (
  SELECT year(l_shipdate) * 10 + quarter(l_shipdate) AS quarter_code, sha256(length(CAST(l_suppkey AS VARCHAR)) || ':' || l_suppkey || '|' || length(l_returnflag) || ':' || l_returnflag || '|' || CASE WHEN l_linenumber = 7 THEN '~' ELSE '1:' || l_linenumber END) AS r
  FROM lineitem) GROUP BY 1, 2)) GROUP BY 1""")
def release_fp(t):
    rows = t.lineitem.select((F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).cast("bigint").alias("quarter_code"), "l_suppkey", "l_returnflag",
                             F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("l_linenumber"))
    return multiset_fingerprint(rows, ["l_suppkey", "l_returnflag", "l_linenumber"], by=["quarter_code"])


# ---------------------------------------------------------------- merge

def _syncs(t: Tables) -> DataFrame:
    return f_product(t).groupBy("source").agg(F.count(F.lit(1)).alias("fetched_count")).withColumn("succeeded", F.col("source") == "BIZINFO")


@query("carry_over", ["f_product"], """SELECT source, carried, count(*) AS row_count, CAST(sum(k) AS BIGINT) AS keys, last_ok FROM (
 SELECT source, FALSE AS carried, k, DATE '2024-06-01' AS last_ok FROM f_product WHERE source = 'BIZINFO' AND k % 10 <> 0
 UNION ALL SELECT source, TRUE, k, DATE '2024-05-20' FROM f_product WHERE source = 'SEMAS_OLS' AND k % 7 <> 0) GROUP BY ALL""")
def carry_over(t):
    p = f_product(t).select("product_key", "source", "line")
    syncs = _syncs(t)
    prev = syncs.select("source", F.lit("2024-05-20").cast("date").alias("last_succeeded_on"), F.lit(5).cast("bigint").alias("fetched_count"))
    rep = C.sync_report(syncs, prev, BASIS).select("source", F.col("last_succeeded_on").alias("last_ok"))
    merged = C.carry_over(p.where("line % 10 <> 0"), p.where("line % 7 <> 0"), syncs)
    return merged.groupBy("source", F.col("carried_over").alias("carried")).agg(F.count(F.lit(1)).alias("row_count"), F.sum("line").alias("keys")).join(rep, "source")


@query("merge_precedence", ["f_product"], """SELECT origin, count(*) AS row_count, CAST(sum(k) AS BIGINT) AS keys FROM f_product p WHERE origin = 'OPERATOR' OR external_id IS NULL OR NOT EXISTS (
 SELECT 1 FROM f_product m WHERE m.origin = 'OPERATOR' AND m.source = p.source AND m.external_id = p.external_id) GROUP BY 1
UNION ALL SELECT 'OVERRIDDEN', count(*), CAST(sum(k) AS BIGINT) FROM f_product p WHERE origin = 'SYNC' AND EXISTS (
 SELECT 1 FROM f_product m WHERE m.origin = 'OPERATOR' AND m.source = p.source AND m.external_id = p.external_id)""")
def merge_precedence(t):
    p = f_product(t).select("product_key", "origin", "source", "external_id", "line")
    auto = p.where("origin = 'SYNC'")
    merged, _ = C.merge_precedence(p.where("origin = 'OPERATOR'"), auto)
    kept = merged.groupBy("origin").agg(F.count(F.lit(1)).alias("row_count"), F.sum("line").alias("keys"))
    lost = auto.join(merged.select("product_key"), "product_key", "left_anti").agg(F.count(F.lit(1)).alias("row_count"), F.sum("line").alias("keys"))
    return kept.unionByName(lost.withColumn("origin", F.lit("OVERRIDDEN")))


@query("added_rows", ["f_product"], """SELECT source, count(*) AS row_count, min(k) AS first_key FROM f_product p WHERE NOT EXISTS (
 SELECT 1 FROM f_product m WHERE m.k % 10 <> 0 AND m.source = p.source AND m.external_id = p.external_id) GROUP BY 1""")
def added_rows(t):
    p = f_product(t).select("source", "external_id", "line")
    return C.added_rows(p, p.where("line % 10 <> 0")).groupBy("source").agg(F.count(F.lit(1)).alias("row_count"), F.min("line").alias("first_key"))


@query("blocked_hidden", ["f_product"], """SELECT count(*) FILTER (h) AS hidden_count, count(*) FILTER (NOT h) AS shown_count FROM (
 SELECT origin = 'SYNC' AND EXISTS (SELECT 1 FROM f_product b WHERE b.k % 9 = 0 AND b.source = p.source AND b.external_id = p.external_id) AS h FROM f_product p)""")
def blocked_hidden(t):
    p = f_product(t).select("product_key", "origin", "source", "external_id", "line")
    _, counts = C.drop_blocked(p, p.where("line % 9 = 0 AND external_id IS NOT NULL"))
    return counts


@query("pinned_lookup", ["f_product"], """SELECT product_key, CASE WHEN k % 4 < 2 AND k % 3 <> 0 THEN 'AVAILABLE' ELSE 'NOT_READ' END AS read_status, CASE WHEN k % 4 < 2 AND k % 3 <> 0 THEN 'f' || k END AS fields FROM f_product""")
def pinned_lookup(t):
    k = F.col("line")
    p = f_product(t).select("product_key", F.sha2(k.cast("string"), 256).alias("text_checksum"), "line")
    e = p.where(k % 4 < 3).select("product_key", F.when(k % 3 == 0, F.lit("other")).otherwise(F.col("text_checksum")).alias("text_checksum"), F.lit("m1").alias("model"),
                                  F.when(k % 4 == 2, "v1").otherwise("v2").alias("prompt_version"), F.concat(F.lit("f"), k.cast("string")).alias("fields"))
    return C.pinned_extraction(p, e, "m1", "v2").select("product_key", "read_status", F.col("extracted").alias("fields"))


@query("membership", ["f_product"], """SELECT product_key, version, row_number() OVER (ORDER BY origin <> 'OPERATOR', CASE WHEN origin = 'OPERATOR' THEN k ELSE 0 END, product_key) - 1 AS position FROM f_product""")
def membership(t):
    return C.membership(f_product(t))


@query("schema_upgrade", ["f_product"], """SELECT product_key, CASE k % 5 WHEN 0 THEN 'SYNC' WHEN 1 THEN 'SYNC' WHEN 2 THEN 'OPERATOR' WHEN 3 THEN 'OPERATOR' END AS origin,
 (['OK', 'OK_LEGACY', 'OK_LEGACY', 'INVALID', 'NONE', 'INVALID'])[k % 6 + 1] AS kind, (['BUSINESS', 'PRE_STARTUP', NULL, NULL, NULL, NULL])[k % 6 + 1] AS business_status,
 CASE WHEN k % 6 < 3 THEN '11' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') END AS district, CASE WHEN k % 6 = 0 THEN CAST(k % 100 AS INTEGER) END AS age FROM f_product""")
def schema_upgrade(t):
    k = F.col("line")
    s = lambda x: x.cast("string")
    d = F.concat(F.lit("11"), F.lpad(s(k % 1000), 3, "0"))
    product = F.when(k % 5 == 0, F.lit('{"origin":"SYNC","reviewer":"kim"}')).when(k % 5 == 1, F.lit('{"reviewer":"AUTO:v1"}')).when(
        k % 5 == 2, F.lit('{"reviewer":"kim"}')).when(k % 5 == 3, F.lit('{"origin":"OPERATOR"}')).otherwise(F.lit('{"name":"x"}'))
    profile = (F.when(k % 6 == 0, F.concat(F.lit('{"businessStatus":"BUSINESS","openedYearMonth":"2020-03","districtCode":"'), d, F.lit('","age":'), s(k % 100), F.lit(',"targetGroups":[]}')))
               .when(k % 6 == 1, F.concat(F.lit('{"businessStage":"PRE_REGISTRATION","districtCode":"'), d, F.lit('","purpose":"RND"}')))
               .when(k % 6 == 2, F.concat(F.lit('{"districtCode":"'), d, F.lit('","businessStage":"UNKNOWN"}')))
               .when(k % 6 == 3, F.lit('{"businessStage":"SOON","districtCode":null}')).when(k % 6 == 5, F.lit('{"age":30}')))
    u = C.upgrade_profile(profile)
    return f_product(t).select("product_key", C.upgrade_origin(product).alias("origin"), u.alias("u")).select(
        "product_key", "origin", "u.kind", "u.business_status", "u.district", "u.age")
