"""Registered matching and grading queries: suppliers as applicants, parts as notices, labels as gold cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.operators import grading as G
from placemetrics.operators import matching as M
from placemetrics.plans.catalog_queries import f_product
from placemetrics.plans.proxies import Tables
from placemetrics.plans.sqlbase import cte, sql

QUERIES, ORACLE = {}, {}
AS_OF = "2024-06-01"
CITY = tuple(str(11000 + i) for i in range(25))
GOLD_CITY = ("11680", "11440", *[str(11000 + i) for i in range(23)])


def query(name: str, needs=None, body: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(needs, body) if needs else body
        return fn
    return add


# ---------------------------------------------------------------- readings by arithmetic on a seed

STEP = {"stage": 1, "business_age": 2, "age": 3, "region": 5, "food": 7, "groups": 11, "period": 13, "support": 17}
GROUP_LISTS = ((), ("YOUTH",), ("WOMEN",), ("DAMAGED",), ("OTHER", "WOMEN"), ("RESTART", "YOUTH"), ("DAMAGED", "DISABLED"))
SUPPORT_LISTS = ("LOAN", "GRANT", "GRANT,LOAN", "SPACE")


def _status(k: Column, name: str) -> Column:
    s = F.floor(k / STEP[name]) % 6
    return F.when(s < 3, "READ").when(s < 5, "NOT_MENTIONED").when(k % 2 == 0, "NOT_READ").otherwise("UNREADABLE")


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def reading(name: str, k: Column) -> Column:
    st = _status(k, name).alias("status")

    def pick(options, mod):
        return F.get(F.array(*[F.lit(o) for o in options]), (k % mod).cast("int"))

    if name == "stage":
        return F.struct(st, pick(("PRE_STARTUP_ONLY", "BUSINESS_ONLY", "BOTH"), 3).alias("value"))
    if name == "business_age":
        lo = F.when(k % 4 != 0, F.when(k % 11 == 0, F.lit(0.3)).otherwise((k % 3) / 2.0))
        return F.struct(st, lo.alias("min"), F.when(k % 5 != 0, (k % 7 + 3).cast("double")).alias("max"), (k % 2 == 0).alias("excl"))
    if name == "age":
        return F.struct(st, F.when(k % 3 != 0, (k % 5 + 18).cast("double")).alias("min"), F.when(k % 4 != 0, (k % 20 + 39).cast("double")).alias("max"),
                        (k % 3 == 1).alias("excl"))
    if name == "region":
        some = F.array(F.when(k % 4 == 0, F.lit("11680")).otherwise((k % 25 + 11000).cast("string")), ((k * 3) % 25 + 11000).cast("string"))
        return F.struct(
            st, pick(("NATIONWIDE", "PROVINCES", "SEOUL_DISTRICTS"), 3).alias("scope"),
            F.when(k % 3 != 1, _texts()).when(k % 4 < 2, _texts("서울")).otherwise(_texts("부산")).alias("provinces"),
            F.when(k % 23 == 0, _texts("서울")).otherwise(_texts()).alias("ex_provinces"),
            F.when(k % 3 == 2, some).otherwise(_texts()).alias("districts"),
            F.when(k % 7 == 0, F.array(((k + 1) % 25 + 11000).cast("string"))).otherwise(_texts()).alias("ex_districts"))
    if name == "food":
        return F.struct(st, F.when(k % 6 == 0, "EXCLUDED").otherwise("NOT_EXCLUDED").alias("value"))
    if name == "groups":
        lists = None
        for i, g in enumerate(GROUP_LISTS):
            lists = F.when(k % 7 == i, _texts(*g)) if lists is None else lists.when(k % 7 == i, _texts(*g))
        return F.struct(st, lists.alias("value"))
    if name == "period":
        return F.struct(st, F.when(k % 5 != 0, F.date_add(F.lit(AS_OF).cast("date"), (k % 40).cast("int") - 20).cast("string")).alias("shown"))
    return F.struct(st, pick(SUPPORT_LISTS, 4).alias("shown"))


def s_status(k: str, name: str) -> str:
    return (f"CASE WHEN ({k}) // {STEP[name]} % 6 < 3 THEN 'READ' WHEN ({k}) // {STEP[name]} % 6 < 5 THEN 'NOT_MENTIONED' "
            f"WHEN ({k}) % 2 = 0 THEN 'NOT_READ' ELSE 'UNREADABLE' END")


def s_reading(name: str, k: str) -> dict[str, str]:
    """The same reading as SQL expressions, one per column."""
    out = {"st": s_status(k, name)}
    if name == "stage":
        out["val"] = f"(['PRE_STARTUP_ONLY', 'BUSINESS_ONLY', 'BOTH'])[({k}) % 3 + 1]"
    elif name == "business_age":
        out |= {"lo": f"CASE WHEN ({k}) % 4 <> 0 THEN CASE WHEN ({k}) % 11 = 0 THEN 0.3::DOUBLE ELSE (({k}) % 3) / 2.0::DOUBLE END END",
                "hi": f"CASE WHEN ({k}) % 5 <> 0 THEN (({k}) % 7 + 3)::DOUBLE END", "excl": f"({k}) % 2 = 0"}
    elif name == "age":
        out |= {"lo": f"CASE WHEN ({k}) % 3 <> 0 THEN (({k}) % 5 + 18)::DOUBLE END", "hi": f"CASE WHEN ({k}) % 4 <> 0 THEN (({k}) % 20 + 39)::DOUBLE END",
                "excl": f"({k}) % 3 = 1"}
    elif name == "region":
        out |= {"scope": f"(['NATIONWIDE', 'PROVINCES', 'SEOUL_DISTRICTS'])[({k}) % 3 + 1]",
                "seoul": f"({k}) % 3 = 1 AND ({k}) % 4 < 2", "exseoul": f"({k}) % 23 = 0",
                "d1": f"CASE WHEN ({k}) % 4 = 0 THEN '11680' ELSE CAST(11000 + ({k}) % 25 AS VARCHAR) END", "d2": f"CAST(11000 + (({k}) * 3) % 25 AS VARCHAR)",
                "ex": f"CASE WHEN ({k}) % 7 = 0 THEN CAST(11000 + (({k}) + 1) % 25 AS VARCHAR) END"}
    elif name == "food":
        out["val"] = f"CASE WHEN ({k}) % 6 = 0 THEN 'EXCLUDED' ELSE 'NOT_EXCLUDED' END"
    elif name == "groups":
        out["val"] = f"CASE ({k}) % 7 " + " ".join(f"WHEN {i} THEN [{', '.join(repr(x) for x in g)}]::VARCHAR[]" for i, g in enumerate(GROUP_LISTS)) + " END"
    elif name == "period":
        out["shown"] = f"CASE WHEN ({k}) % 5 <> 0 THEN CAST(DATE '{AS_OF}' + CAST(({k}) % 40 - 20 AS INTEGER) AS VARCHAR) END"
    else:
        out["shown"] = "(['" + "', '".join(SUPPORT_LISTS) + f"'])[({k}) % 4 + 1]"
    return out


def s_columns(name: str, k: str, prefix: str) -> str:
    return ", ".join(f"{e} AS {prefix}{c}" for c, e in s_reading(name, k).items())


def s_unread(p: str, v: str) -> str:
    return f"CASE WHEN {p}st <> 'READ' THEN 'CHECK:' || {p}st ELSE {v} END"


def _yn(c: str) -> str:
    return f"CASE WHEN {c} THEN 'MATCH' ELSE 'MISMATCH' END"


def _inr(v: str, p: str) -> str:
    return f"(({p}lo IS NULL OR {v} >= {p}lo) AND ({p}hi IS NULL OR CASE WHEN {p}excl THEN {v} < {p}hi ELSE {v} <= {p}hi END))"


def s_verdict(name: str, p: str, as_of: str, age: str = "a_") -> str:
    """Verdict SQL over reading columns with prefix ``p`` and profile columns ps, po, pd, pa, pg."""
    if name == "stage":
        return s_unread(p, f"CASE WHEN {p}val = 'BOTH' THEN 'MATCH' WHEN ps IS NULL THEN 'CHECK:INPUT_MISSING' WHEN ({p}val = 'PRE_STARTUP_ONLY') = (ps = 'PRE_STARTUP') THEN 'MATCH' ELSE 'MISMATCH' END")
    if name == "business_age":
        t = f"DATE '{as_of}'"
        a = "CAST(po || '-01' AS DATE)"
        z = f"least(last_day({a}), {t})"
        ml, mh = f"CAST(round({p}lo * 12) AS INTEGER)", f"CAST(round({p}hi * 12) AS INTEGER)"
        frac = f"(coalesce(abs({p}lo * 12 - round({p}lo * 12)) > 1e-9, FALSE) OR coalesce(abs({p}hi * 12 - round({p}hi * 12)) > 1e-9, FALSE))"

        def young(d):
            return f"coalesce(CAST({d} + to_months({ml}) AS DATE) > {t}, FALSE)"

        def old(d):
            return f"coalesce(CASE WHEN {p}excl THEN {t} >= CAST({d} + to_months({mh}) AS DATE) ELSE {t} > CAST({d} + to_months({mh}) AS DATE) END, FALSE)"

        return s_unread(p, f"CASE WHEN {p}lo IS NULL AND {p}hi IS NULL THEN 'MATCH' WHEN ps IS NULL THEN 'CHECK:INPUT_MISSING' WHEN ps = 'PRE_STARTUP' THEN {_yn(_inr('0', p))} "
                        f"WHEN po IS NULL THEN 'CHECK:INPUT_MISSING' WHEN {frac} OR {a} > {t} THEN 'CHECK:UNCERTAIN' WHEN {young(a)} OR {old(z)} THEN 'MISMATCH' "
                        f"WHEN NOT {young(z)} AND NOT {old(a)} THEN 'MATCH' ELSE 'CHECK:UNCERTAIN' END")
    if name == "age":
        return s_unread(p, f"CASE WHEN {p}lo IS NULL AND {p}hi IS NULL THEN 'MATCH' WHEN pa IS NULL THEN 'CHECK:INPUT_MISSING' ELSE {_yn(_inr('pa', p))} END")
    if name == "region":
        whole = f"({p}scope = 'NATIONWIDE' OR ({p}scope = 'PROVINCES' AND {p}seoul))"
        return s_unread(p, f"CASE WHEN pd IS NULL THEN CASE WHEN {whole} AND NOT {p}exseoul AND {p}ex IS NULL THEN 'MATCH' ELSE 'CHECK:INPUT_MISSING' END WHEN {p}exseoul OR coalesce({p}ex = pd, FALSE) THEN 'MISMATCH' "
                        f"WHEN {p}scope = 'SEOUL_DISTRICTS' THEN {_yn(f'pd IN ({p}d1, {p}d2)')} ELSE {_yn(whole)} END")
    if name == "food":
        return s_unread(p, _yn(f"{p}val <> 'EXCLUDED'"))
    g = f"{p}val"
    youth = (f"CASE WHEN {age}st <> 'READ' OR {age}hi IS NULL THEN 'UNCERTAIN' WHEN pa IS NULL THEN 'INPUT_MISSING' WHEN {_inr('pa', age)} THEN 'IN' ELSE 'OUT' END")
    kinds = (f"list_transform({g}, lambda x: CASE WHEN x = 'OTHER' THEN 'UNCERTAIN' WHEN x = 'DAMAGED' THEN 'OUT' WHEN x = 'YOUTH' THEN {youth} WHEN pg IS NULL THEN 'INPUT_MISSING' "
             "WHEN list_contains(pg, x) THEN 'IN' ELSE 'OUT' END)")
    return s_unread(p, f"CASE WHEN len({g}) = 0 OR list_contains({kinds}, 'IN') THEN 'MATCH' WHEN list_contains({kinds}, 'INPUT_MISSING') THEN 'CHECK:INPUT_MISSING' "
                    f"WHEN list_contains({kinds}, 'UNCERTAIN') THEN 'CHECK:UNCERTAIN' ELSE 'MISMATCH' END")


PREFIX = {"stage": "s_", "business_age": "b_", "age": "a_", "region": "r_", "food": "f_", "groups": "g_"}
_ALL_V = ["v_" + n for n in M.CONDITIONS]


def s_mark(region: str, st: str) -> str:
    return (f"CASE WHEN mark = '서울' AND {st} <> 'READ' THEN 'MATCH' WHEN mark IS NOT NULL AND NOT contains(mark, '서울') AND NOT contains(mark, '전국') AND {region} = 'CHECK:NOT_MENTIONED' "
            f"THEN 'CHECK:TITLE_REGION_MARK' ELSE {region} END")


def s_group(cols: list[str]) -> str:
    arr = "[" + ", ".join(cols) + "]"
    return (f"CASE WHEN list_contains({arr}, 'MISMATCH') THEN 'NOT_MATCHING' WHEN len(list_filter({arr}, lambda x: x <> 'MATCH')) = 0 THEN 'MATCHING' "
            f"WHEN len(list_filter({arr}, lambda x: x <> 'MATCH' AND x <> 'CHECK:NOT_MENTIONED')) = 0 THEN 'NOT_MENTIONED_ONLY' ELSE 'NEEDS_CHECK' END")


# ---------------------------------------------------------------- proxies

MARKS = ("[서울] ", "[부산] ", "[전국] ", "", "  [ 경기 ] ")


def f_notice(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    basis = F.lit(AS_OF).cast("date")
    rows = t.spread("part").select(
        F.concat(F.lit("p-"), k.cast("string")).alias("product_key"), k.alias("position"), *[reading(n, k).alias(n) for n in M.CONDITIONS],
        F.concat(F.get(F.array(*[F.lit(m) for m in MARKS]), (k % 5).cast("int")), F.col("p_name")).alias("name"),
        F.when(k % 3 == 0, "OPERATOR").otherwise("SYNC").alias("origin"), F.when(k % 2 == 0, "SEMAS_OLS").otherwise("BIZINFO").alias("source"),
        F.when(k % 4 == 1, F.lit("금융")).otherwise(F.lit("기술")).alias("category"), F.when(k % 6 == 0, "LOAN").otherwise("GRANT").alias("support_type"),
        F.when(k % 10 == 0, "CLOSED").when(k % 10 < 3, "UNKNOWN").otherwise("OPEN").alias("status"),
        F.when(k % 8 != 0, F.date_add(basis, (k % 60).cast("int") - 10)).alias("period_end"),
        _status(k, "period").alias("ai_period_status"), F.date_add(basis, (k % 40).cast("int") - 20).alias("ai_period_end"))
    rows = rows.withColumns({"mark": M.title_mark(F.col("name"), F.col("origin"), F.col("source")),
                             "tab": M.assign_tab(F.col("origin"), F.col("source"), F.col("category"), F.col("support_type"))})
    syncs = t.part.select(F.when(k % 2 == 0, "SEMAS_OLS").otherwise("BIZINFO").alias("source")).distinct().withColumn(
        "last_succeeded_on", F.date_add(basis, F.when(F.col("source") == "BIZINFO", -5).otherwise(-2)))
    return M.open_state(rows, syncs, AS_OF)


def f_profile(t: Tables) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    status = F.when(s % 3 == 1, "PRE_STARTUP").when(s % 3 == 2, "BUSINESS")
    opened = F.when((s % 3 == 2) & (s % 4 != 0), F.concat((s % 25 + 2000).cast("string"), F.lit("-"), F.lpad((s % 12 + 1).cast("string"), 2, "0")))
    groups = F.when(s % 4 == 1, _texts()).when(s % 4 == 2, _texts("WOMEN")).when(s % 4 == 3, _texts("DISABLED", "RESTART"))
    return t.supplier.select(s.alias("profile_id"), G.profile(status, opened, F.when(s % 5 != 0, (n + 11000).cast("string")),
                                                             F.when(s % 7 != 0, (s % 63 + 18).cast("int")), groups).alias("profile"))


cte("f_notice", (), "SELECT p_partkey AS k, 'p-' || p_partkey AS product_key, " + ", ".join(s_columns(n, "p_partkey", PREFIX[n]) for n in M.CONDITIONS) + f""",
 CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 1 THEN (['서울', '부산', '전국', NULL, '경기'])[p_partkey % 5 + 1] END AS mark,
 CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 OR p_partkey % 4 = 1 THEN 'POLICY_FUND' ELSE 'SUPPORT_PROGRAM' END WHEN p_partkey % 6 = 0 THEN 'POLICY_FUND' ELSE 'SUPPORT_PROGRAM' END AS tab,
 CASE WHEN p_partkey % 10 = 0 THEN 'SOURCE_STATUS' WHEN p_partkey % 8 <> 0 AND p_partkey % 60 < 10 THEN 'SOURCE_END_DATE' END AS closed_by,
 array_to_string(list_filter([CASE WHEN p_partkey % 10 < 3 THEN 'STATUS_NOT_OPEN' END, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 1 THEN 'SOURCE_STALE' END,
  CASE WHEN p_partkey // 13 % 6 < 3 AND p_partkey % 40 < 20 THEN 'AI_END_DATE_PASSED' END], lambda x: x IS NOT NULL), ',') AS unconfirmed FROM part""")
cte("f_profile", (), """SELECT s_suppkey AS sk, CASE s_suppkey % 3 WHEN 1 THEN 'PRE_STARTUP' WHEN 2 THEN 'BUSINESS' END AS ps,
 CASE WHEN s_suppkey % 3 = 2 AND s_suppkey % 4 <> 0 THEN (2000 + s_suppkey % 25) || '-' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') END AS po,
 CASE WHEN s_suppkey % 5 <> 0 THEN CAST(11000 + s_nationkey AS VARCHAR) END AS pd, CASE WHEN s_suppkey % 7 <> 0 THEN 18 + s_suppkey % 63 END AS pa,
 CASE s_suppkey % 4 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['WOMEN'] WHEN 3 THEN ['DISABLED', 'RESTART'] END AS pg FROM supplier""")
_SIX = ", ".join((s_mark(s_verdict(n, PREFIX[n], AS_OF), "r_st") if n == "region" else s_verdict(n, PREFIX[n], AS_OF)) + f" AS v_{n}" for n in M.CONDITIONS)
cte("f_pairs", ("f_notice", "f_profile"), f"SELECT *, {s_group(_ALL_V)} AS grp FROM (SELECT sk, k, product_key, tab, closed_by, unconfirmed, {_SIX} FROM f_notice CROSS JOIN f_profile)")
_PLAIN = ", ".join(s_verdict(n, PREFIX[n], AS_OF) + f" AS v_{n}" for n in M.CONDITIONS)
cte("f_asked", ("f_notice", "f_profile"), f"SELECT sk, k, {_PLAIN} FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN f_notice ON k = l_partkey JOIN f_profile ON sk = l_suppkey")


def asked(t: Tables) -> DataFrame:
    """(applicant, notice) pairs of a request table: the supplier and part pairs of the lines."""
    pairs = t.lineitem.select(F.col("l_suppkey").alias("profile_id"), F.col("l_partkey").alias("position")).distinct()
    return pairs.join(f_notice(t), "position").join(f_profile(t), "profile_id")


def _tally(t: Tables, name: str) -> DataFrame:
    v = M.verdict(name, {n: F.col(n) for n in M.CONDITIONS}, F.col("profile"), F.lit(AS_OF).cast("date"))
    return asked(t).groupBy("profile_id", v.alias("verdict")).agg(F.count(F.lit(1)).alias("row_count"), F.sum("position").alias("keys"))


def _tally_sql(name: str) -> str:
    return f"SELECT sk AS profile_id, v_{name} AS verdict, count(*) AS row_count, CAST(sum(k) AS BIGINT) AS keys FROM f_asked GROUP BY 1, 2"


@query("match_age_bounds", ["f_asked"], _tally_sql("business_age"))
def match_age_bounds(t):
    return _tally(t, "business_age")


@query("match_region", ["f_asked"], _tally_sql("region"))
def match_region(t):
    return _tally(t, "region")


@query("match_groups", ["f_asked"], _tally_sql("groups"))
def match_groups(t):
    return _tally(t, "groups")


@query("match_applicant_age", ["f_asked"], _tally_sql("age"))
def match_applicant_age(t):
    return _tally(t, "age")


@query("match_stage", ["f_asked"], _tally_sql("stage"))
def match_stage(t):
    return _tally(t, "stage")


@query("title_mark", ["f_notice"], f"""SELECT product_key, mark, {s_mark("CASE WHEN r_st = 'READ' THEN 'MISMATCH' ELSE 'CHECK:' || r_st END", 'r_st')} AS region FROM f_notice""")
def title_mark(t):
    v = M.unread(F.col("region"), F.lit("MISMATCH"))
    return f_notice(t).select("product_key", "mark", M.apply_title_mark(v, F.col("region.status"), F.col("mark")).alias("region"))


@query("tab_assign", ["f_notice"], "SELECT product_key, tab FROM f_notice")
def tab_assign(t):
    return f_notice(t).select("product_key", "tab")


@query("open_state", ["f_notice"], """SELECT product_key, closed_by, CASE WHEN closed_by IS NULL THEN unconfirmed ELSE '' END AS unconfirmed,
 CASE WHEN closed_by IS NOT NULL THEN 'CLOSED' WHEN unconfirmed = '' THEN 'OPEN_CONFIRMED' ELSE 'UNCONFIRMED' END AS application_state FROM f_notice""")
def open_state(t):
    return f_notice(t).select("product_key", "closed_by", F.array_join("unconfirmed", ",").alias("unconfirmed"), "application_state")


def pairs(t: Tables) -> DataFrame:
    return M.match_list(f_notice(t), f_profile(t), AS_OF, CITY)


@query("match_pairs", ["f_pairs"], "SELECT sk AS profile_id, product_key, grp AS \"group\", " + ", ".join(_ALL_V) + " FROM f_pairs WHERE closed_by IS NULL AND grp <> 'NOT_MATCHING'")
def match_pairs(t):
    return pairs(t).select("profile_id", "product_key", "group", *_ALL_V)


@query("match_counts", ["f_pairs"], """SELECT p.sk AS profile_id, t.tab, count(*) FILTER (closed_by IS NULL AND grp = 'MATCHING') AS matching, count(*) FILTER (closed_by IS NULL AND grp = 'NOT_MENTIONED_ONLY') AS not_mentioned_only,
 count(*) FILTER (closed_by IS NULL AND grp = 'NEEDS_CHECK') AS needs_check, count(*) FILTER (closed_by IS NULL AND grp = 'NOT_MATCHING') AS not_matching, count(closed_by) AS closed
FROM f_profile p CROSS JOIN (VALUES ('POLICY_FUND'), ('SUPPORT_PROGRAM')) t(tab) LEFT JOIN f_pairs x ON x.sk = p.sk AND x.tab = t.tab GROUP BY 1, 2""")
def match_counts(t):
    return M.match_counts(f_notice(t), f_profile(t), AS_OF)


@query("match_groups_final", ["f_pairs"], """SELECT product_key, count(*) FILTER (closed_by IS NULL AND grp = 'MATCHING') AS matching, count(*) FILTER (closed_by IS NULL AND grp = 'NOT_MENTIONED_ONLY') AS not_mentioned_only,
 count(*) FILTER (closed_by IS NULL AND grp = 'NEEDS_CHECK') AS needs_check, count(*) FILTER (closed_by IS NULL AND grp = 'NOT_MATCHING') AS not_matching, count(closed_by) AS closed FROM f_pairs GROUP BY 1""")
def match_groups_final(t):
    return M.product_counts(f_notice(t), f_profile(t), AS_OF)


@query("match_order", ["f_pairs"], """SELECT * FROM (SELECT sk AS profile_id, tab, product_key, order_key, CAST(row_number() OVER (PARTITION BY sk, tab ORDER BY order_key, k) AS INTEGER) AS rank FROM (
 SELECT *, CAST((list_position(['MATCHING', 'NOT_MENTIONED_ONLY', 'NEEDS_CHECK'], grp) - 1) * 2 + CASE WHEN unconfirmed = '' THEN 0 ELSE 1 END AS INTEGER) AS order_key FROM f_pairs WHERE closed_by IS NULL AND grp <> 'NOT_MATCHING')) WHERE rank <= 10""")
def match_order(t):
    return M.first_page(f_notice(t), f_profile(t), AS_OF, 10).select("profile_id", "tab", "product_key", "order_key", "rank")


@query("readings", ["f_product", "f_evid"], f"""
, e AS (SELECT k, bool_or(subject = 'BUSINESS_STAGE' AND method <> 'SEARCH_RESULT_SUMMARY') AS st, bool_or(subject = 'REGION') AS re FROM f_evid GROUP BY 1),
x AS (SELECT p.*, {s_status('p.k', 'stage')} AS sst, {s_status('p.k', 'region')} AS rst, origin = 'OPERATOR' AND len(stages) > 0 AND st AS us,
 origin = 'OPERATOR' AND (rscope IN ('NATIONWIDE', 'SEOUL') OR (rscope = 'DISTRICTS' AND len(dcodes) > 0)) AND re AS ur FROM f_product p JOIN e ON e.k = p.k)
SELECT product_key, CASE WHEN us THEN 'READ' ELSE sst END AS stage_status, CASE WHEN us THEN CASE WHEN len(stages) = 2 THEN 'BOTH' ELSE 'PRE_STARTUP_ONLY' END WHEN sst = 'READ' THEN (['PRE_STARTUP_ONLY', 'BUSINESS_ONLY', 'BOTH'])[k % 3 + 1] END AS stage_value,
 CASE WHEN us THEN 'OPERATOR' WHEN sst = 'READ' THEN 'AI' END AS stage_source, CASE WHEN ur THEN 'READ' ELSE rst END AS region_status,
 CASE WHEN ur THEN CASE rscope WHEN 'SEOUL' THEN 'PROVINCES' WHEN 'DISTRICTS' THEN 'SEOUL_DISTRICTS' ELSE rscope END WHEN rst = 'READ' THEN (['NATIONWIDE', 'PROVINCES', 'SEOUL_DISTRICTS'])[k % 3 + 1] END AS region_scope,
 CASE WHEN ur THEN 'OPERATOR' WHEN rst = 'READ' THEN 'AI' END AS region_source FROM x""")
def readings(t):
    p = f_product(t)
    k = F.col("line")
    r = M.select_readings(p.withColumns({"read_stage": reading("stage", k), "read_region": reading("region", k)}))
    return r.select("product_key", F.col("stage_reading.status").alias("stage_status"), F.col("stage_reading.value").alias("stage_value"),
                    F.col("stage_reading.source").alias("stage_source"), F.col("region_reading.status").alias("region_status"),
                    F.col("region_reading.value").alias("region_scope"), F.col("region_reading.source").alias("region_source"))


@query("profile_rules", None, """SELECT s_suppkey AS profile_id, CASE WHEN s_suppkey % 13 = 1 THEN 'INVALID_STATUS' WHEN s_suppkey % 13 = 2 THEN 'INVALID_MONTH' WHEN s_suppkey % 13 = 3 THEN 'FUTURE_MONTH'
 WHEN s_suppkey % 13 = 4 THEN 'UNKNOWN_DISTRICT' WHEN s_suppkey % 13 = 5 THEN 'INVALID_AGE' WHEN s_suppkey % 13 = 6 THEN 'INVALID_GROUP' WHEN s_suppkey % 13 = 7 THEN 'REPEATED_GROUP' WHEN s_suppkey % 13 = 8 THEN 'MONTH_WITHOUT_BUSINESS' END AS issue,
 CASE WHEN s_suppkey % 13 = 4 THEN '99999' WHEN s_suppkey % 2 = 0 THEN CAST(11000 + s_nationkey AS VARCHAR) WHEN s_suppkey % 3 <> 0 THEN '11024' END AS district,
 CASE WHEN s_suppkey % 13 = 4 OR s_suppkey % 2 = 0 THEN 'FUNDING_PROFILE' WHEN s_suppkey % 3 <> 0 THEN 'BUSINESS_PROFILE' END AS district_source FROM supplier""")
def profile_rules(t):
    s = F.col("s_suppkey")
    m = s % 13
    status = F.when(m == 1, F.lit("RETIRED")).when(m == 8, F.lit("PRE_STARTUP")).otherwise(F.lit("BUSINESS"))
    opened = F.when(m == 2, F.lit("2020-13")).when(m == 3, F.lit("2024-07")).otherwise(F.lit("2020-03"))
    district = F.when(m == 4, F.lit("99999")).when(s % 2 == 0, (F.col("s_nationkey") + 11000).cast("string"))
    age = F.when(m == 5, F.lit(121)).when(s % 3 != 0, F.lit(40))
    groups = F.when(m == 6, _texts("YOUTH")).when(m == 7, _texts("WOMEN", "WOMEN")).when(s % 5 != 0, _texts())
    d = t.supplier.select(s.alias("profile_id"), G.profile(status, opened, district, age, groups).alias("profile"),
                          F.when(s % 3 == 0, F.lit("26110")).otherwise(F.lit("11024")).alias("business"))
    v = M.validate_profiles(d, CITY, AS_OF)
    f = M.district_fallback(F.col("profile.district"), F.col("business"), CITY)
    return v.select("profile_id", "issue", f["district"].alias("district"), f["source"].alias("district_source"))


# ---------------------------------------------------------------- grading

FIELD_NO = {n: i for i, n in enumerate(G.FIELDS)}


def f_gold(t: Tables) -> DataFrame:
    """Two runs per labelled document: answers and acceptable readings of the eight fields."""
    d, r = F.col("doc_id"), F.col("run")
    rows = t.spread("labels").join(t.spread("documents").select("doc_id"), "doc_id").select(
        "doc_id", F.when(d % 2 == 0, "dev").otherwise("test").alias("set_name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("run"),
        F.get(F.array(F.lit("서울"), F.lit("부산"), F.lit(None).cast("string")), (d % 3).cast("int")).alias("mark"))
    cols = {}
    for n, i in FIELD_NO.items():
        cols[f"a_{n}"] = reading(n, F.when((d + r * 3 + i) % 4 != 0, d).otherwise(d + 1 + r))
        more = F.filter(F.array(F.when(d % 3 == i % 3, reading(n, d + 2)), F.when(d % 7 == i, reading(n, d + 5))), lambda x: x.isNotNull())
        cols[f"g_{n}"] = F.concat(F.array(reading(n, d)), more)
    return rows.withColumns(cols)


cte("f_runs", (), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS set_name, r AS run, (['서울', '부산', NULL])[doc_id % 3 + 1] AS mark FROM labels JOIN documents USING (doc_id) CROSS JOIN range(2) t(r)")


def _opts(name: str) -> str:
    i = FIELD_NO[name]
    return (f"SELECT doc_id, run, -1 AS o, CASE WHEN (doc_id + run * 3 + {i}) % 4 <> 0 THEN doc_id ELSE doc_id + 1 + run END AS seed FROM f_runs UNION ALL SELECT doc_id, run, 0, doc_id FROM f_runs "
            f"UNION ALL SELECT doc_id, run, 1, doc_id + 2 FROM f_runs WHERE doc_id % 3 = {i % 3} UNION ALL SELECT doc_id, run, 2, doc_id + 5 FROM f_runs WHERE doc_id % 7 = {i}")


def _profile_sql(ps="'BUSINESS'", po="'2023-03'", pd="'11680'", pa="37", pg="[]::VARCHAR[]") -> str:
    return f"{ps} AS ps, {po} AS po, {pd} AS pd, CAST({pa} AS INTEGER) AS pa, {pg} AS pg"


_NOW = 2026 * 12 + 10
_SETS = "(SELECT NULL::VARCHAR[] AS pg UNION ALL SELECT list_filter(['WOMEN', 'DISABLED', 'RESTART'], lambda x: (b >> (list_position(['WOMEN', 'DISABLED', 'RESTART'], x) - 1)) % 2 = 1) FROM range(8) t(b))"


def _probes(name: str) -> str:
    """Probes per (doc_id, run) as rows."""
    base = "SELECT DISTINCT doc_id, run FROM f_runs"
    if name == "stage":
        return " UNION ALL ".join(f"SELECT doc_id, run, {p} FROM f_runs" for p in (_profile_sql("'PRE_STARTUP'", "NULL"), _profile_sql(), _profile_sql("NULL")))
    if name == "business_age":
        m = ("SELECT doc_id, run, m FROM f_runs CROSS JOIN (VALUES (1), (30), (60), (130), (400)) v(m) UNION SELECT doc_id, run, CAST(round(y * 12) + d AS INTEGER) FROM (SELECT doc_id, run, unnest([x_lo, x_hi]) AS y FROM o_business_age WHERE x_st = 'READ') "
             "CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) v(d) WHERE y IS NOT NULL AND round(y * 12) + d >= 0")
        opened = f"(({_NOW} - m) // 12) || '-' || lpad(CAST(({_NOW} - m) % 12 + 1 AS VARCHAR), 2, '0')"
        return " UNION ALL ".join(f"SELECT doc_id, run, {p} FROM f_runs" for p in (_profile_sql("'PRE_STARTUP'", "NULL"), _profile_sql(po="NULL"), _profile_sql("NULL", "NULL"))) + f" UNION ALL SELECT doc_id, run, {_profile_sql(po=opened)} FROM ({m})"
    near = "unnest([b - 1, b, b + 1])"
    pts = "SELECT doc_id, run, a FROM f_runs CROSS JOIN (VALUES (0), (18), (25), (37), (45), (60), (120)) v(a)"
    if name == "age":
        a = f"{pts} UNION SELECT doc_id, run, a FROM (SELECT doc_id, run, CAST({near} AS INTEGER) AS a FROM (SELECT doc_id, run, unnest([x_lo, x_hi]) AS b FROM o_age WHERE x_st = 'READ') WHERE b IS NOT NULL) WHERE a BETWEEN 0 AND 120"
        return f"SELECT doc_id, run, {_profile_sql(pa='a')} FROM ({a} UNION ALL SELECT doc_id, run, NULL FROM f_runs)"
    if name == "region":
        codes = ", ".join(f"('{c}')" for c in GOLD_CITY)
        return f"SELECT doc_id, run, {_profile_sql(pd='c')} FROM f_runs CROSS JOIN (VALUES (NULL), {codes}) v(c)"
    if name == "food":
        return f"SELECT doc_id, run, {_profile_sql()} FROM f_runs"
    a = (f"{pts} UNION SELECT doc_id, run, a FROM f_runs CROSS JOIN (VALUES (38), (39), (40)) v(a) UNION SELECT doc_id, run, a FROM (SELECT doc_id, run, CAST({near} AS INTEGER) AS a FROM "
         "(SELECT doc_id, run, unnest([x_lo, x_hi]) AS b FROM o_age WHERE x_st = 'READ' AND o = 0) WHERE b IS NOT NULL) WHERE a BETWEEN 0 AND 120")
    return f"SELECT doc_id, run, {_profile_sql(pa='a', pg='s.pg')} FROM ({a} UNION ALL SELECT doc_id, run, NULL FROM f_runs) CROSS JOIN {_SETS} s"


for _n in G.FIELDS:
    cte(f"o_{_n}", ("f_runs",), f"SELECT doc_id, run, o, {s_columns(_n, 'seed', 'x_')} FROM ({_opts(_n)})")
for _n in M.CONDITIONS:
    _need = ("f_runs", f"o_{_n}", "o_age")
    cte(f"p_{_n}", _need, "SELECT *, row_number() OVER (PARTITION BY doc_id, run) AS pn FROM (" + _probes(_n) + ")")
    _age = "JOIN (SELECT doc_id, run, x_st AS c_st, x_lo AS c_lo, x_hi AS c_hi, x_excl AS c_excl FROM o_age WHERE o = 0) c USING (doc_id, run)" if _n == "groups" else ""
    cte(f"v_{_n}", (f"p_{_n}", f"o_{_n}", "o_age"), f"""SELECT doc_id, run, o, x_st AS st, pn, CASE WHEN v LIKE 'CHECK%' THEN 'CHECK' ELSE v END AS v FROM (SELECT doc_id, run, o, x_st, pn, {s_verdict(_n, 'x_', G.AS_OF, 'c_')} AS v FROM p_{_n} JOIN o_{_n} USING (doc_id, run) {_age})""")
    cte(f"z_{_n}", (f"v_{_n}",), f"""SELECT doc_id, run, CASE WHEN bool_or(same AND st_same) THEN 'CORRECT' WHEN bool_or(same) THEN 'EQUIVALENT' WHEN bool_or(NOT misled) THEN 'MISSED' ELSE 'CONFIDENT_WRONG' END AS outcome FROM (
 SELECT a.doc_id, a.run, g.o, bool_and(a.v = g.v) AS same, any_value(a.st) = any_value(g.st) AS st_same, bool_or(a.v <> 'CHECK' AND a.v <> g.v) AS misled FROM v_{_n} a JOIN v_{_n} g ON a.doc_id = g.doc_id AND a.run = g.run AND a.pn = g.pn WHERE a.o = -1 AND g.o >= 0 GROUP BY 1, 2, 3) GROUP BY 1, 2""")
for _n in G.DISPLAYED:
    cte(f"z_{_n}", (f"o_{_n}",), f"""SELECT a.doc_id, a.run, CASE WHEN bool_or(s AND a.x_st = g.x_st) THEN 'CORRECT' WHEN bool_or(s) THEN 'EQUIVALENT' WHEN any_value(a.x_st) = 'READ' THEN 'DISPLAY_WRONG' ELSE 'MISSED' END AS outcome
 FROM (SELECT * FROM o_{_n} WHERE o = -1) a JOIN (SELECT * FROM o_{_n} WHERE o >= 0) g ON a.doc_id = g.doc_id AND a.run = g.run,
 LATERAL (SELECT coalesce(CASE WHEN a.x_st = 'READ' THEN a.x_shown END, '∅') = coalesce(CASE WHEN g.x_st = 'READ' THEN g.x_shown END, '∅') AS s) GROUP BY 1, 2""")
cte("f_outcome", tuple(f"z_{n}" for n in G.FIELDS), "SELECT doc_id, run, " + ", ".join(f"z_{n}.outcome AS o_{n}" for n in G.FIELDS) + " FROM z_stage " + " ".join(f"JOIN z_{n} USING (doc_id, run)" for n in G.FIELDS[1:]))

_GP = {n: _profile_sql(*[("NULL" if v is None else ("[]::VARCHAR[]" if v == [] else (str(v) if isinstance(v, int) else repr(v)))) for v in p]) for n, p in G.GROUP_PROFILES.items()}
for _n in M.CONDITIONS:
    _age2 = "JOIN (SELECT doc_id, run, o AS ao, x_st AS c_st, x_lo AS c_lo, x_hi AS c_hi, x_excl AS c_excl FROM o_age) c USING (doc_id, run)" if _n == "groups" else ""
    _v = s_verdict(_n, "x_", G.AS_OF, "c_")
    if _n == "region":
        _v = s_mark(_v, "x_st")
    cte(f"w_{_n}", (f"o_{_n}", "o_age"), f"SELECT doc_id, run, gp, o, {'ao,' if _n == 'groups' else ''} {_v} AS v FROM o_{_n} {_age2} JOIN f_runs USING (doc_id, run) CROSS JOIN ("
        + " UNION ALL ".join(f"SELECT '{g}' AS gp, {p}" for g, p in _GP.items()) + ") q")
_J = " ".join(f"JOIN w_{n} {PREFIX[n]}w ON {PREFIX[n]}w.doc_id = s_w.doc_id AND {PREFIX[n]}w.run = s_w.run AND {PREFIX[n]}w.gp = s_w.gp" + (" AND g_w.ao = a_w.o" if n == "groups" else "") for n in M.CONDITIONS[1:])
_GR = s_group([f"{PREFIX[n]}w.v" for n in M.CONDITIONS])
_MINE = " AND ".join(f"{PREFIX[n]}w.o = -1" for n in M.CONDITIONS)
_GOLD = " AND ".join(f"{PREFIX[n]}w.o >= 0" for n in M.CONDITIONS)
cte("f_groups", tuple(f"w_{n}" for n in M.CONDITIONS), f"""SELECT m.doc_id, m.run, m.gp, CASE WHEN list_contains(golds, m.grp) THEN 'SAME' WHEN m.grp IN ('MATCHING', 'NOT_MENTIONED_ONLY') THEN 'SURFACED' ELSE 'OTHER' END AS outcome
 FROM (SELECT s_w.doc_id, s_w.run, s_w.gp, {_GR} AS grp FROM w_stage s_w {_J} WHERE {_MINE}) m JOIN (SELECT doc_id, run, gp, list(DISTINCT grp) AS golds FROM (SELECT s_w.doc_id, s_w.run, s_w.gp, {_GR} AS grp FROM w_stage s_w {_J} WHERE {_GOLD}) GROUP BY 1, 2, 3) g USING (doc_id, run, gp)""")
_F8 = "[" + ", ".join(f"o_{n}" for n in G.FIELDS) + "]"


def _n8(*kinds: str) -> str:
    return f"len(list_filter({_F8}, lambda x: x IN ({', '.join(repr(k) for k in kinds)})))"


cte("f_scores", ("f_outcome", "f_groups"), f"""SELECT doc_id, run, {_n8('CORRECT', 'EQUIVALENT')} / 8.0::DOUBLE AS field_acc, {_n8('CORRECT')} / 8.0::DOUBLE AS exact_acc, {_n8('CONFIDENT_WRONG')} / 6.0::DOUBLE AS confident_wrong,
 {_n8('MISSED')} / 8.0::DOUBLE AS missed, changed / 3.0::DOUBLE AS group_changed, surfaced / 3.0::DOUBLE AS group_surfaced FROM f_outcome JOIN (SELECT doc_id, run, count(*) FILTER (outcome <> 'SAME') AS changed, count(*) FILTER (outcome = 'SURFACED') AS surfaced FROM f_groups GROUP BY 1, 2) USING (doc_id, run)""")


@query("field_outcomes", ["f_outcome"], "SELECT doc_id, CAST(run AS INTEGER) AS run, " + ", ".join(f"o_{n}" for n in G.FIELDS) + " FROM f_outcome")
def field_outcomes(t):
    return G.field_outcomes(f_gold(t), GOLD_CITY).select("doc_id", "run", *[f"o_{n}" for n in G.FIELDS])


@query("group_outcomes", ["f_groups"], "SELECT doc_id, CAST(run AS INTEGER) AS run, " + ", ".join(f"max(CASE WHEN gp = '{g}' THEN outcome END) AS q_{g.lower()}" for g in G.GROUP_PROFILES) + " FROM f_groups GROUP BY 1, 2")
def group_outcomes(t):
    g = G.group_outcomes(f_gold(t), ["doc_id", "run"])
    return g.select("doc_id", "run", *[F.col(f"q_{p}").alias(f"q_{p.lower()}") for p in G.GROUP_PROFILES])


def scored_runs(t: Tables) -> DataFrame:
    return G.case_scores(G.field_outcomes(G.group_outcomes(f_gold(t), ["doc_id", "run"]), GOLD_CITY))


@query("case_scores", ["f_scores"], "SELECT doc_id, CAST(run AS INTEGER) AS run, " + ", ".join(f"round({m}, 9) AS {m}" for m in G.METRICS) + " FROM f_scores")
def case_scores(t):
    return scored_runs(t).select("doc_id", "run", *[F.round(m, 9).alias(m) for m in G.METRICS])


@query("set_summary", ["f_scores"], "SELECT set_name, count(*) AS cases, CAST(sum(runs) AS BIGINT) AS runs, " + ", ".join(
    f"round(avg({m}), 8) AS {m}_mean, round(coalesce(stddev_samp({m}), 0) * 1.96 / sqrt(count({m})), 8) AS {m}_half" for m in G.METRICS)
    + " FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS set_name, doc_id, count(*) AS runs, " + ", ".join(f"avg({m}) AS {m}" for m in G.METRICS) + " FROM f_scores GROUP BY 1, 2) GROUP BY 1")
def set_summary(t):
    s = G.set_summary(scored_runs(t), "doc_id", cases=t.documents.select("doc_id"))
    return s.select("set_name", "cases", "runs", *[F.round(f"{m}_{x}", 8).alias(f"{m}_{x}") for m in G.METRICS for x in ("mean", "half")])


@query("gold_combos", ["f_runs"], "SELECT doc_id, CAST(run AS INTEGER) AS run, " + " * ".join(
    f"(1 + CASE WHEN doc_id % 3 = {i % 3} THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 = {i} THEN 1 ELSE 0 END)" for n, i in FIELD_NO.items() if n in M.CONDITIONS) + " AS combos FROM f_runs")
def gold_combos(t):
    return G.expand_gold(f_gold(t), ["doc_id", "run"]).groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("combos")).withColumn("combos", F.col("combos").cast("int"))


@query("probe_profiles", tuple(f"p_{n}" for n in M.CONDITIONS), " UNION ALL ".join(
    f"SELECT doc_id, CAST(run AS INTEGER) AS run, '{n}' AS field, count(*) AS probes, min(po) AS first_month, CAST(max(pa) AS INTEGER) AS oldest, count(pd) AS with_district, CAST(sum(coalesce(len(pg), 0)) AS BIGINT) AS group_marks FROM p_{n} GROUP BY 1, 2" for n in M.CONDITIONS))
def probe_profiles(t):
    g = f_gold(t)
    context_age = F.get("g_age", F.lit(0))
    out = None
    arrays = F.array(*[F.struct(F.lit(n).alias("field"), G.probe_profiles(n, F.concat(F.array(F.col(f"a_{n}")), F.col(f"g_{n}")), context_age, GOLD_CITY).alias("probes"))
                       for n in M.CONDITIONS])
    out = g.select("doc_id", "run", F.explode(arrays).alias("x")).select("doc_id", "run", "x.field", F.explode("x.probes").alias("p"))
    return out.groupBy("doc_id", "run", "field").agg(
        F.count(F.lit(1)).alias("probes"), F.min("p.opened").alias("first_month"), F.max("p.age").alias("oldest"), F.count("p.district").alias("with_district"),
        F.sum(F.coalesce(F.array_size("p.groups"), F.lit(0))).alias("group_marks"))
