"""Registered notice queries over documents, pages, benchmark and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions import text as TX
from placemetrics.operators import notices as N
from placemetrics.operators import verify as V
from placemetrics.plans.proxies import Tables
from placemetrics.plans.sqlbase import cte, sql

QUERIES, ORACLE = {}, {}
AS_OF = "2024-10-01"


def query(name: str, needs=None, body: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(needs, body) if needs else body
        return fn
    return add


# ---------------------------------------------------------------- period texts

def period_text(fmt: Column, day: Column) -> Column:
    """Eight ways in which a notice writes its period; 4 to 7 cannot be read."""
    end = F.date_add(day, 30)
    iso, words = (lambda d: F.date_format(d, "yyyy-MM-dd")), (lambda d: F.date_format(d, "M월 d일"))
    return (F.when(fmt == 0, F.concat(iso(day), F.lit(" ~ "), iso(end)))
            .when(fmt == 1, F.concat(F.date_format(day, "yyyy. M. d."), F.lit(" (목) 09:30 ∼ 재원 소진 때까지")))
            .when(fmt == 2, F.concat(F.lit("`"), F.date_format(day, "yy년 "), words(day), F.lit(" 09:30 ~ "), words(end), F.lit(" 17:30")))
            .when(fmt == 3, F.concat(F.lit("'"), F.date_format(day, "yy-MM-dd"), F.lit(" (금) 9:00 ～ 16:30까지")))
            .when(fmt == 4, F.concat(F.date_format(day, "yyyy"), F.lit("-02-30 ~ "), F.date_format(day, "yyyy"), F.lit("-03-10")))
            .when(fmt == 5, F.lit("상시"))
            .when(fmt == 6, F.date_format(day, "yyyy년 M월 d일부터"))
            .otherwise(F.concat(iso(end), F.lit(" ~ "), iso(day))))


def day_of(k: Column, span: int = 600) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (k % span).cast("int"))


def s_start(fmt: str, d: str) -> str:
    return f"CASE WHEN {fmt} IN (0, 1, 2, 3) THEN {d} END"


def s_end(fmt: str, d: str) -> str:
    return f"CASE WHEN {fmt} IN (0, 2) THEN {d} + 30 WHEN {fmt} = 3 THEN {d} END"


_DAY = "(DATE '2024-01-01' + CAST(doc_id % 600 AS INTEGER))"


@query("period_strict", None, f"""SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN {_DAY} END AS start_day, CASE WHEN doc_id % 8 = 0 THEN {_DAY} + 30 END AS end_day FROM documents""")
def period_strict(t):
    k = F.col("doc_id")
    p = N.parse_period_strict(period_text(k % 8, day_of(k)))
    return t.spread("documents").select("doc_id", p["start"].alias("start_day"), p["end"].alias("end_day"))


@query("period_free", None, f"""SELECT doc_id, {s_start('doc_id % 8', _DAY)} AS start_day, {s_end('doc_id % 8', _DAY)} AS end_day,
 CASE WHEN doc_id % 8 = 1 THEN '재원 소진 때까지' END AS note FROM documents""")
def period_free(t):
    k = F.col("doc_id")
    p = N.parse_period(period_text(k % 8, day_of(k)))
    return t.spread("documents").select("doc_id", p["start"].alias("start_day"), p["end"].alias("end_day"), p["note"].alias("note"))


_AMOUNT = "CASE k % 6 WHEN 0 THEN k % 9 * 100000000 WHEN 1 THEN 70000000 + k % 9 * 1000000 WHEN 2 THEN 100000000 + k % 90 * 10000 WHEN 3 THEN 4 * 1000000 + k % 7 * 10000 END"


@query("amount_words", None, f"SELECT k AS partkey, nullif({_AMOUNT}, 0) AS won FROM (SELECT p_partkey AS k FROM part)")
def amount_words(t):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    text = (F.when(k % 6 == 0, F.concat(s(k % 9), F.lit("억원"))).when(k % 6 == 1, F.concat(F.lit("7천"), s(k % 9), F.lit("백만원")))
            .when(k % 6 == 2, F.concat(F.lit("1억 "), s(k % 90), F.lit("만 원"))).when(k % 6 == 3, F.concat(F.lit("4백"), s(k % 7), F.lit("만원")))
            .when(k % 6 == 4, F.concat(F.lit("시설 1억원, 운전 "), s(k % 9), F.lit("천만원"))).otherwise(F.lit("별도 협의")))
    return t.part.select(k.alias("partkey"), N.parse_single_amount(text).alias("won"))


# ---------------------------------------------------------------- text

@query("text_normalise", None, r"""SELECT doc_id, length(x) AS chars, sha256(x) AS digest FROM (SELECT doc_id,
 replace(replace(text, '. ', '.' || chr(10)), 'e ', 'e') AS x FROM documents)""")
def text_normalise(t):
    dirty = F.regexp_replace(F.regexp_replace("text", r"\. ", ".\r\n"), "e ", "\u0001e\u0007")
    clean = TX.normalise_text(dirty)
    return t.spread("documents").select("doc_id", F.length(clean).cast("bigint").alias("chars"), F.sha2(clean, 256).alias("digest"))


@query("html_lines", None, r"""
WITH raw AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(html, '<title>', '&lt;title class=&quot;x&quot;&gt;'), '&lt;title class=&quot;x&quot;&gt;', '<title>'), '<\s*br\s*/?>|</\s*(p|div|li|tr|h[0-9])\s*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS x FROM pages),
l AS (SELECT page_id, list_filter(list_transform(string_split(x, chr(10)), lambda s: trim(regexp_replace(replace(replace(replace(s, '&quot;', '"'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda s: s <> '') AS lines FROM raw)
SELECT page_id, CAST(len(lines) AS INTEGER) AS line_count, lines[1] AS first_line, sha256(array_to_string(lines, chr(10))) AS digest FROM l""")
def html_lines(t):
    html = F.replace(F.col("html"), F.lit("<title>"), F.lit("&lt;title class=&quot;x&quot;&gt;"))
    p = t.spread("pages").select("page_id", TX.html_to_lines(html).alias("lines"))
    return p.select("page_id", F.size("lines").alias("line_count"), F.get("lines", F.lit(0)).alias("first_line"),
                    F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))


@query("mask_secret", None, r"""SELECT doc_id, CAST(length(x) AS BIGINT) AS chars, sha256(x) AS digest FROM (SELECT doc_id,
 text || '|***|' || doc_id || '|***|***' AS x FROM documents)""")
def mask_secret(t):
    secret = "a b%2Bc/=="
    body = F.concat(F.col("text"), F.lit(f"|{secret}|"), F.col("doc_id").cast("string"), F.lit("|a%20b%252Bc%2F%3D%3D|a b+c/=="))
    masked = TX.mask_secret(body, secret)
    return t.spread("documents").select("doc_id", F.length(masked).cast("bigint").alias("chars"), F.sha2(masked, 256).alias("digest"))


@query("host_filter", None, r"""SELECT page_id, coalesce(regexp_matches(url, '^https://([a-z0-9-]+\.)*(example\.com|example\.net)(/|$)'), FALSE) AS official FROM pages""")
def host_filter(t):
    return t.spread("pages").select("page_id", N.official_url(F.col("url"), ["example.com", "example.net"]).alias("official"))


# ---------------------------------------------------------------- documents of a notice

def f_parts(t: Tables) -> DataFrame:
    """Five documents make one notice: the first is inline, the others are files."""
    k = F.col("doc_id")
    ord_ = (k % 5).cast("int")
    name = F.concat(F.lit("file "), k.cast("string"), F.when(k % 17 == 0, F.lit(".xlsx")).when(k % 2 == 0, F.lit(".pdf")).otherwise(F.lit(".HWPX ")))
    return t.spread("documents").select(
        F.floor(k / 5).alias("notice_id"), ord_.alias("ord"), F.when(ord_ == 0, "API_SUMMARY").when(ord_ == 1, "PRINT_FILE").otherwise("ATTACHMENT").alias("kind"),
        F.when(ord_ == 0, F.lit("개요")).otherwise(name).alias("name"), F.concat(F.lit("https://x.kr/"), k.cast("string")).alias("url"),
        F.when(k % 29 == 0, F.lit(" \n")).when(k % 5 == 4, F.lit("같은 첨부")).when((k % 5 == 3) & (k % 3 == 0), F.lit("같은 첨부")).otherwise(F.col("text")).alias("text"),
        F.when(k % 31 == 3, "FAILED").when(k % 37 == 2, "TRANSIENT").otherwise("OK").alias("fetch"),
        F.when(k % 41 == 3, F.lit(40_000_000)).otherwise(F.length("text")).cast("bigint").alias("bytes"))


cte("f_parts", (), r"""SELECT *, CASE WHEN ord = 0 THEN CASE WHEN blank THEN 'NO_TEXT' ELSE 'READ' END WHEN doc_id % 17 = 0 THEN 'UNSUPPORTED_TYPE'
  WHEN doc_id % 31 = 3 THEN 'DOWNLOAD_FAILED' WHEN doc_id % 37 = 2 THEN 'TRANSIENT' WHEN doc_id % 41 = 3 THEN 'TOO_LARGE'
  WHEN ord > min(CASE WHEN ord > 0 AND doc_id % 17 <> 0 AND doc_id % 31 <> 3 AND doc_id % 37 <> 2 AND doc_id % 41 <> 3 THEN ord END) OVER (PARTITION BY notice_id, text) THEN 'DUPLICATE'
  WHEN blank THEN 'NO_TEXT' ELSE 'READ' END AS status FROM (SELECT doc_id, doc_id // 5 AS notice_id, doc_id % 5 AS ord, doc_id % 29 = 0 AS blank,
   CASE WHEN doc_id % 5 = 0 THEN '개요' ELSE 'file ' || doc_id || CASE WHEN doc_id % 17 = 0 THEN '.xlsx' WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.HWPX ' END END AS name,
   CASE WHEN doc_id % 29 = 0 THEN ' ' || chr(10) WHEN doc_id % 5 = 4 OR (doc_id % 5 = 3 AND doc_id % 3 = 0) THEN '같은 첨부' ELSE text END AS text FROM documents)""")
cte("f_built", ("f_parts",), r"""SELECT notice_id, CASE WHEN bool_or(status = 'TRANSIENT') THEN 'INCOMPLETE' WHEN count(*) FILTER (status = 'READ') = 0 THEN 'NO_TEXT' ELSE 'COMPLETE' END AS outcome,
 NOT bool_or(status = 'DOWNLOAD_FAILED') AS settled, count(*) AS document_count,
 string_agg('[' || CASE ord WHEN 0 THEN '사업개요' WHEN 1 THEN '본문출력파일' ELSE '첨부' END || ': ' || name || ']' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY ord) FILTER (status = 'READ') AS body
 FROM f_parts GROUP BY 1""")


@query("notice_assemble", ["f_built"], """SELECT notice_id, outcome, settled, document_count, CASE WHEN outcome = 'COMPLETE' THEN sha256(body) END AS checksum FROM f_built""")
def notice_assemble(t):
    return N.assemble(N.part_statuses(f_parts(t))).select("notice_id", "outcome", "settled", "document_count", "checksum")


@query("notice_outcome", ["f_built"], """SELECT notice_id, o AS text_outcome, CASE o WHEN 'REUSED' THEN prev WHEN 'INCOMPLETE' THEN prev WHEN 'STORED' THEN sha256(body) END AS text_checksum FROM (
 SELECT *, CASE WHEN notice_id % 3 = 0 AND notice_id % 5 <> 0 THEN 'REUSED' WHEN outcome = 'INCOMPLETE' THEN 'INCOMPLETE' WHEN outcome = 'NO_TEXT' THEN 'NO_TEXT' ELSE 'STORED' END AS o,
  CASE WHEN notice_id % 4 <> 1 THEN 'prev-' || notice_id END AS prev FROM f_built)""".replace("notice_id % 3 = 0 AND notice_id % 5 <> 0", "notice_id % 3 = 0 AND notice_id % 5 <> 0 AND notice_id % 4 <> 1"))
def notice_outcome(t):
    parts, n = f_parts(t), F.col("notice_id")
    built = N.assemble(N.part_statuses(parts))
    signatures = N.plan_signature(parts)
    previous = signatures.where(n % 4 != 1).select(
        "notice_id", F.concat(F.lit("prev-"), n.cast("string")).alias("previous_checksum"),
        F.when(n % 3 == 0, F.col("signature")).otherwise(F.lit("other")).alias("previous_signature"), (n % 5 != 0).alias("previous_settled"))
    return N.resolve_text(built, signatures, previous)


@query("file_type_check", None, """SELECT CASE WHEN doc_id % 4 IN (0, 1, 2) AND doc_id % 7 <> 0 THEN (['PDF', 'HWP', 'HWPX'])[doc_id % 4 + 1] END AS file_type, count(*) AS row_count FROM documents GROUP BY 1""")
def file_type_check(t):
    k = F.col("doc_id")
    magic = F.when(k % 7 == 0, F.lit("00")).when(k % 4 == 0, F.hex(F.lit("x%PDF-1.7"))).when(k % 4 == 1, F.lit("D0CF11E0A1B11AE1")).otherwise(F.lit("504B0304"))
    content = F.concat(F.unhex(magic), F.encode("text", "UTF-8"))
    name = F.concat(k.cast("string"), F.when(k % 4 == 0, F.lit(".PDF")).when(k % 4 == 1, F.lit(".hwp")).when(k % 4 == 2, F.lit(".hwpx ")).otherwise(F.lit(".zip")))
    return t.spread("documents").groupBy(N.file_type(name, content).alias("file_type")).agg(F.count(F.lit(1)).alias("row_count"))


@query("paired_split", None, """SELECT doc_id, CAST(i AS INTEGER) AS ord, doc_id % 5 <> 0 AS paired, CASE WHEN doc_id % 5 <> 0 THEN 'f' || i || '.pdf' ELSE '' END AS name,
 'https://x.kr/get?id=' || doc_id || '_' || i || CASE WHEN i % 2 = 0 THEN '' ELSE '&v=1' END AS url FROM (SELECT doc_id, unnest(range(doc_id % 4)) AS i FROM documents)""")
def paired_split(t):
    k = F.col("doc_id")
    n = (k % 4).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    paths = F.array_join(F.transform(idx, lambda i: F.concat(
        F.lit(" https://x.kr/get?"), F.when(i % 2 == 0, F.concat(F.lit("downloadToken=zz&id="), k.cast("string"), F.lit("_"), i.cast("string")))
        .otherwise(F.concat(F.lit("id="), k.cast("string"), F.lit("_"), i.cast("string"), F.lit("&downloadToken=q&v=1"))))), "@")
    names = F.concat(F.array_join(F.transform(idx, lambda i: F.concat(F.lit("f"), i.cast("string"), F.lit(".pdf"))), "@ "), F.when(k % 5 == 0, F.lit("@extra.pdf")).otherwise(F.lit("")))
    d = t.spread("documents").select("doc_id", paths.alias("paths"), names.alias("names"))
    return N.split_files(d, "paths", "names").select("doc_id", "ord", "paired", "name", "url")


# ---------------------------------------------------------------- selection and status

@query("notice_skip", None, f"""SELECT skip, count(*) AS row_count FROM (SELECT doc_id, CASE WHEN doc_id % 23 = 0 OR doc_id % 19 = 0 THEN 'MALFORMED' WHEN rn > 1 THEN 'DUPLICATE'
  WHEN doc_id % 3 = 0 THEN 'NOT_TARGET' WHEN doc_id % 8 = 0 AND {_DAY} + 30 < DATE '{AS_OF}' THEN 'ENDED' ELSE 'KEPT' END AS skip FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 23 = 0 OR doc_id % 19 = 0, doc_id % 701 ORDER BY doc_id) AS rn FROM documents)) GROUP BY 1""")
def notice_skip(t):
    k = F.col("doc_id")
    d = t.spread("documents").select(
        (k % 701).alias("notice_id"), k.alias("line"), F.when(k % 23 == 0, F.lit("x")).otherwise(F.concat(F.lit("공고 "), F.substring("text", 1, 40))).alias("name"),
        F.when(k % 19 == 0, F.lit("ftp://x")).otherwise(F.lit("https://x.kr/1")).alias("url"), F.concat(F.lit("org "), F.col("source")).alias("organization"),
        F.when(k % 3 == 0, F.lit("중소기업")).when(k % 3 == 1, F.lit("소상공인, 중소기업")).otherwise(F.lit("창업벤처")).alias("target"),
        period_text(k % 8, day_of(k)).alias("period"))
    s = N.select_notices(d, AS_OF)
    return s.groupBy(F.coalesce("skip", F.lit("KEPT")).alias("skip")).agg(F.count(F.lit(1)).alias("row_count"))


_CF, _NF = "(doc_id % 8)", "(doc_id // 8 % 8)"
_ND = "(DATE '2024-01-01' + CAST((doc_id + doc_id % 3 % 2) % 600 AS INTEGER))"
cte("f_status", (), f"""SELECT *, CASE WHEN st IS NULL THEN ns WHEN e0 < s0 THEN NULL ELSE s0 END AS ps, CASE WHEN st IS NULL THEN ne WHEN e0 < s0 THEN NULL ELSE e0 END AS pe FROM (
 SELECT *, coalesce(cs, ns) AS s0, coalesce(ce, CASE WHEN ne IS NOT NULL AND (cs IS NULL OR ns = cs) THEN ne END) AS e0 FROM (
 SELECT doc_id, {_CF} AS cf, (['접수중', '접수 중', '접수마감', '예정', '접수중'])[doc_id % 6] AS st, {s_start(_CF, _DAY)} AS cs, {s_end(_CF, _DAY)} AS ce,
  {s_start(_NF, _ND)} AS ns, {s_end(_NF, _ND)} AS ne FROM documents))""")


@query("status_resolve", ["f_status"], f"""SELECT doc_id, CASE WHEN st IS NULL THEN 'UNKNOWN' WHEN st = '접수마감' THEN 'CLOSED' WHEN st IN ('접수중', '접수 중') AND conflicts = '' THEN 'OPEN' ELSE 'UNKNOWN' END AS status,
 CASE WHEN st IS NULL THEN 'NO_CARD' ELSE conflicts END AS conflicts, ps AS period_start, pe AS period_end FROM (SELECT *, array_to_string(list_filter([
  CASE WHEN cs IS NULL AND cf <> 5 THEN 'PERIOD_UNREADABLE' END, CASE WHEN cs <> ns THEN 'START_DIFFERS' END, CASE WHEN ce <> ne THEN 'END_DIFFERS' END,
  CASE WHEN e0 < s0 THEN 'END_BEFORE_START' END, CASE WHEN ps > DATE '{AS_OF}' AND st IN ('접수중', '접수 중') THEN 'STARTS_LATER' END,
  CASE WHEN pe < DATE '{AS_OF}' AND st IN ('접수중', '접수 중') THEN 'ENDED_BEFORE' END, CASE WHEN st = '예정' THEN 'NOT_OPEN_MARK' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM f_status)""")
def status_resolve(t):
    k = F.col("doc_id")
    marks = F.array(*[F.lit(x) for x in ("접수중", "접수 중", "접수마감", "예정", "접수중")])
    d = t.spread("documents").select(
        "doc_id", F.when(k % 6 != 0, F.get(marks, (k % 6 - 1).cast("int"))).alias("card_status"),
        F.concat(F.lit(" 접수 기간 : "), period_text(k % 8, day_of(k))).alias("card_period"),
        period_text(F.floor(k / 8) % 8, day_of(k + k % 3 % 2)).alias("notice_period"))
    r = N.resolve_status(d, AS_OF)
    return r.select("doc_id", F.col("application_status").alias("status"), F.array_join("conflicts", ",").alias("conflicts"), "period_start", "period_end")


@query("status_downgrade", None, """SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'UNKNOWN' ELSE (['OPEN', 'CLOSED', 'UNKNOWN'])[page_id % 3 + 1] END AS status FROM pages""")
def status_downgrade(t):
    k = F.col("page_id")
    status = F.get(F.array(F.lit("OPEN"), F.lit("CLOSED"), F.lit("UNKNOWN")), (k % 3).cast("int"))
    lines = F.array_append(TX.html_to_lines(F.col("html")), F.when(k % 2 == 0, F.lit("제외: 음식점업")).otherwise(F.lit("제외 없음")))
    return t.spread("pages").select("page_id", N.downgrade_status(status, lines).alias("status"))


# ---------------------------------------------------------------- funds

def _fund_rows(t: Tables, part: DataFrame | None = None) -> DataFrame:
    k = F.col("p_partkey")
    section = F.when(k % 2 == 0, "직접대출").otherwise("대리대출")
    name = F.concat(F.when(k % 3 == 0, F.lit("소상공인 ")).otherwise(F.lit("")), F.col("p_name"), F.lit(" 자금"))
    suffix = F.get(F.array(*[F.lit(x) for x in ("(직접대출) 접수 안내", " 신청안내", "(일반)(대리대출) 신청 안내", " 금리인하 신청안내", "(피해) 접수안내", "")]), (k % 6).cast("int"))
    return (t.part if part is None else part).select(k.alias("seq"), section.alias("section"), name.alias("fund_name"),
                         F.concat(F.lit("[공지] "), F.col("p_name"), F.lit(" 자금"), suffix).alias("title"))


_FUND = "replace(p_name, ' ', '') || '자금'"
_SEC = "CASE WHEN p_partkey % 2 = 0 THEN '직접대출' ELSE '대리대출' END"


@query("fund_key", None, f"""SELECT p_partkey AS seq, 'fund-' || CASE WHEN p_partkey % 2 = 0 THEN 'direct' ELSE 'agency' END || '-' || substr(sha256({_SEC} || ':' || {_FUND}), 1, 10) AS fund_key,
 p_partkey % 6 IN (0, 1, 2) AS announces FROM part""")
def fund_key(t):
    f = _fund_rows(t)
    return f.select("seq", N.fund_key(F.col("section"), F.col("fund_name")).alias("fund_key"),
                    N.title_matches(N.normal_fund_name(F.col("fund_name")), F.col("title")).alias("announces"))


@query("latest_per_key", None, f"""WITH x AS (SELECT {_SEC} AS section, {_FUND} AS fund, p_partkey AS k, p_partkey % 6 IN (0, 1, 2) AND p_partkey % 5 <> 0 AS m FROM part)
SELECT f.section, f.fund, max(n.k) AS seq FROM (SELECT DISTINCT section, fund FROM x) f JOIN x n ON n.m AND n.section = f.section AND ends_with(n.fund, f.fund) GROUP BY 1, 2""")
def latest_per_key(t):
    f = _fund_rows(t, t.dealt("part", "p_partkey"))
    got = N.latest_notice(f.select("section", "fund_name"), f.select("section", "seq", "title", F.when(F.col("seq") % 5 == 0, "일반").otherwise(N.LOAN_CATEGORY).alias("category")))
    return got.select("section", N.normal_fund_name(F.col("fund_name")).alias("fund"), "seq").distinct()


# ---------------------------------------------------------------- quotes and values

def f_quotes(t: Tables) -> DataFrame:
    """Per document: a true quote, an altered one, a short one, one across title and body, one of a benchmark item."""
    txt = F.col("text")
    items = t.benchmark.select(F.col("item_id"), F.col("text").alias("item"))
    d = t.spread("documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    j = d.join(items, "item_id", "left")
    q = F.array(
        F.struct(F.lit("true").alias("field"), F.substring(txt, 50, 60).alias("quote")),
        F.struct(F.lit("altered").alias("field"), F.concat(F.substring(txt, 50, 60), F.lit("§")).alias("quote")),
        F.struct(F.lit("short").alias("field"), F.substring(txt, 1, 3).alias("quote")),
        F.struct(F.lit("span").alias("field"), F.concat(F.lit("공고"), F.substring(txt, 1, 10)).alias("quote")),
        F.struct(F.lit("item").alias("field"), F.col("item").alias("quote")),
        F.struct(F.lit("title").alias("field"), F.lit("제목 공고").alias("quote")))
    a = j.select("doc_id", F.explode(q).alias("q")).select("doc_id", "q.field", "q.quote")
    return a.withColumns({"mentioned": F.col("doc_id") % 9 != 0, "has_value": F.col("doc_id") % 11 != 0})


def _titles(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", F.concat(F.lit("제목 공고 "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"))


_CQ = r"regexp_replace({0}, '\s+', '', 'g')"


@query("quote_verify", None, f"""
WITH d AS (SELECT doc_id, text, {_CQ.format('text')} AS body, '제목공고' || doc_id AS title FROM documents),
q AS (SELECT doc_id, 'true' AS field, substr(text, 50, 60) AS quote FROM documents UNION ALL SELECT doc_id, 'altered', substr(text, 50, 60) || '§' FROM documents
 UNION ALL SELECT doc_id, 'short', substr(text, 1, 3) FROM documents UNION ALL SELECT doc_id, 'span', '공고' || substr(text, 1, 10) FROM documents
 UNION ALL SELECT doc_id, 'item', b.text FROM documents d LEFT JOIN benchmark b ON item_id = doc_id % 40 UNION ALL SELECT doc_id, 'title', '제목 공고' FROM documents)
SELECT doc_id, field, CASE WHEN doc_id % 9 = 0 THEN 'NOT_MENTIONED' WHEN doc_id % 11 = 0 OR trim(coalesce(quote, '')) = '' THEN 'NO_VALUE'
 WHEN length({_CQ.format('quote')}) < 4 THEN 'TOO_SHORT' WHEN contains(body, {_CQ.format('quote')}) OR contains(title, {_CQ.format('quote')}) THEN 'VERIFIED' ELSE 'NOT_FOUND' END AS quote_status
FROM q JOIN d USING (doc_id)""")
def quote_verify(t):
    return V.verify_quotes(f_quotes(t), _titles(t), "doc_id").select("doc_id", "field", "quote_status")


@query("quote_compact")
def quote_compact(t):
    """Compaction with compatibility folding of whole texts, after widening some characters."""
    wide = F.translate("text", "aeo. ", "ａｅｏ．　")
    return t.spread("documents").select("doc_id", F.length(TX.compact_quote(wide)).alias("chars"),
                              (TX.compact_quote(wide) == TX.compact_quote(F.col("text"))).alias("same"))


_PROV = ("서울", "부산", "대구", "인천")
_DIST = ("강남구", "중구", "동구", "강서구")


def f_answers(t: Tables) -> DataFrame:
    """Values of the eight fields by arithmetic on the document id."""
    k = F.col("doc_id")

    def pick(options, mod, shift=0):
        return F.get(F.array(*[F.lit(o) for o in options]), ((k + shift) % mod).cast("int"))

    def arr(cond_values):
        out = None
        for m, values in cond_values:
            a = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
            out = F.when(k % 8 == m, a) if out is None else out.when(k % 8 == m, a)
        return out.otherwise(F.array().cast("array<string>"))

    num = lambda c: c.cast("double")
    return t.spread("documents").select(
        "doc_id", pick((*V.STAGES, "ANY"), 4).alias("stage"), pick((*V.FOOD, "MAYBE"), 3).alias("food"),
        F.when(k % 5 != 0, num(k % 7)).alias("b_min"), F.when(k % 6 != 0, num(k % 9)).alias("b_max"), (k % 2 == 0).alias("b_excl"),
        F.when(k % 4 != 0, num(k % 40) + F.when(k % 13 == 0, 0.5).otherwise(0.0)).alias("a_min"), F.when(k % 7 != 0, num(k % 130)).alias("a_max"), (k % 3 == 0).alias("a_excl"),
        pick((*V.SCOPES, "CITY"), 4, 1).alias("scope"),
        arr([(1, ["서울"]), (2, ["서울", "부산"]), (3, ["서울"]), (4, ["제주섬"]), (5, ["서울"]), (6, []), (7, ["서울", "서울"])]).alias("provinces"),
        arr([(1, []), (2, ["강남구"]), (3, ["강남구", "중구"]), (5, ["해운대구"]), (7, ["중구"])]).alias("districts"),
        arr([(0, ["YOUTH"]), (1, ["WOMEN", "OLD"]), (2, [])]).alias("groups"), arr([(0, ["LOAN"]), (1, ["LOAN", "GIFT"]), (3, ["GRANT"])]).alias("types"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.lit("2024-02-30")).otherwise(F.date_format(day_of(k), "yyyy-MM-dd")).alias("p_start"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.date_format(day_of(k + k % 3 - 1), "yyyy-MM-dd")).alias("p_end"),
        F.when(k % 3 == 0, F.lit("상시")).alias("p_text"),
        F.when(k % 3 == 0, F.lit("강남구 소재")).otherwise(F.lit("관내")).alias("r_quote"), F.when(k % 2 == 0, F.lit("중구 공고")).otherwise(F.lit("공고")).alias("r_title"))


_SCOPE = "(['NATIONWIDE','PROVINCES','SEOUL_DISTRICTS','CITY'])[(doc_id + 1) % 4 + 1]"


@query("value_checks", None, f"""
WITH a AS (SELECT doc_id, doc_id % 8 AS m, {_SCOPE} AS scope,
 CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END AS bmin, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 9 END AS bmax,
 CASE WHEN doc_id % 4 <> 0 THEN doc_id % 40 + CASE WHEN doc_id % 13 = 0 THEN 0.5 ELSE 0 END END AS amin, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 130 END AS amax,
 CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'bad' ELSE 'ok' END AS ps, CASE WHEN doc_id % 4 <> 0 THEN (doc_id + doc_id % 3 - 1) % 600 END AS pe FROM documents)
SELECT doc_id, 'stage' AS field, CASE WHEN doc_id % 4 = 3 THEN 'NOT_AN_OPTION' END AS reason FROM a
UNION ALL SELECT doc_id, 'food', CASE WHEN doc_id % 3 = 2 THEN 'NOT_AN_OPTION' END FROM a
UNION ALL SELECT doc_id, 'business_age', CASE WHEN bmax IS NOT NULL AND (coalesce(bmin, 0) > bmax OR (doc_id % 2 = 0 AND coalesce(bmin, 0) = bmax)) THEN 'EMPTY_RANGE' END FROM a
UNION ALL SELECT doc_id, 'age', CASE WHEN doc_id % 4 <> 0 AND doc_id % 13 = 0 THEN 'NOT_WHOLE' WHEN amax > 120 THEN 'OUT_OF_BOUNDS'
  WHEN amax IS NOT NULL AND (coalesce(amin, 0) > amax OR (doc_id % 3 = 0 AND coalesce(amin, 0) = amax)) THEN 'EMPTY_RANGE' END FROM a
UNION ALL SELECT doc_id, 'region', CASE WHEN scope = 'CITY' THEN 'NOT_AN_OPTION' WHEN m = 4 THEN 'UNKNOWN_PROVINCE' WHEN scope = 'NATIONWIDE' AND m IN (1, 2, 3, 5, 7) THEN 'NATIONWIDE_WITH_PROVINCES'
  WHEN scope = 'PROVINCES' AND m IN (0, 6) THEN 'PROVINCES_MISSING' WHEN scope = 'SEOUL_DISTRICTS' AND m NOT IN (2, 3, 5, 7) THEN 'DISTRICTS_MISSING'
  WHEN scope <> 'SEOUL_DISTRICTS' AND m IN (2, 3, 5, 7) THEN 'DISTRICTS_NOT_ALLOWED' WHEN m = 2 THEN 'NOT_THE_CAPITAL' WHEN m = 5 THEN 'UNKNOWN_DISTRICT'
  WHEN (m IN (2, 3) AND doc_id % 3 <> 0) OR (m IN (3, 7) AND doc_id % 2 <> 0) THEN 'DISTRICT_NOT_QUOTED' END FROM a
UNION ALL SELECT doc_id, 'target_groups', CASE WHEN m = 1 THEN 'NOT_AN_OPTION' END FROM a
UNION ALL SELECT doc_id, 'support_types', CASE WHEN m NOT IN (0, 1, 3) THEN 'EMPTY_LIST' WHEN m = 1 THEN 'NOT_AN_OPTION' END FROM a
UNION ALL SELECT doc_id, 'period', CASE WHEN ps IS NULL AND pe IS NULL AND doc_id % 3 <> 0 THEN 'NO_PERIOD' WHEN ps = 'bad' THEN 'NOT_A_DATE' WHEN ps = 'ok' AND doc_id % 600 > pe THEN 'REVERSED' END FROM a""")
def value_checks(t):
    c = F.col
    region = V.region_reason(c("scope"), c("provinces"), c("districts"), F.array().cast("array<string>"), _PROV, _DIST)
    quoted = V.districts_quoted(c("districts"), TX.compact_quote_latin(c("r_quote")), TX.compact_quote_latin(c("r_title")))
    fields = {
        "stage": V.enum_reason(c("stage"), V.STAGES), "food": V.enum_reason(c("food"), V.FOOD),
        "business_age": V.range_reason(c("b_min"), c("b_max"), c("b_excl"), 0, V.BUSINESS_AGE_LIMIT),
        "age": V.range_reason(c("a_min"), c("a_max"), c("a_excl"), 0, V.AGE_LIMIT, whole=True),
        "region": F.coalesce(region, F.when(~quoted, F.lit("DISTRICT_NOT_QUOTED"))),
        "target_groups": V.list_reason(c("groups"), V.GROUPS, need_one=False), "support_types": V.list_reason(c("types"), V.SUPPORT, need_one=True),
        "period": V.period_reason(c("p_start"), c("p_end"), c("p_text"))}
    cells = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("reason")) for k, v in fields.items()])
    return f_answers(t).select("doc_id", F.explode(cells).alias("x")).select("doc_id", "x.field", "x.reason")


@query("extract_worklist", None, """SELECT work, count(*) AS row_count FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'CACHED' WHEN doc_id % 5 = 0 THEN 'NO_TEXT'
 WHEN length(text) > 3000 THEN 'TOO_LONG' ELSE 'TO_DO' END AS work FROM documents) GROUP BY 1""")
def extract_worklist(t):
    k = F.col("doc_id")
    d = t.spread("documents").select(k.alias("product_key"), F.sha2("text", 256).alias("text_checksum"), "text")
    p = F.col("product_key")
    cache = d.where(p % 2 == 0).select("product_key", "text_checksum", F.lit("m1").alias("model"), F.when(p % 3 == 0, "v2").otherwise("v1").alias("prompt_version"))
    odd = d.where(p % 3 == 0).select("product_key", "text_checksum", F.lit("m1").alias("model"), F.lit("v2").alias("prompt_version"))
    texts = d.where(p % 5 != 0)
    w = V.extraction_worklist(d.select("product_key", "text_checksum"), cache.unionByName(odd), texts, "m1", "v2", limit=3000)
    return w.groupBy("work").agg(F.count(F.lit(1)).alias("row_count"))


