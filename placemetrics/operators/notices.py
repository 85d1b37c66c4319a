"""Notices: periods, amounts, hosts, files, text assembly, application status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.hashing import multiset_fingerprint
from placemetrics.functions.money import let
from placemetrics.functions.text import compact, normalise_text
from placemetrics.operators.quality import first_reason, issue_array, missing_or

# Labels, statuses, patterns and lists of the sources.
KIND_LABELS = {"API_SUMMARY": "사업개요", "NOTICE_PAGE": "공지 본문", "FUND_TABLE": "정책자금 표",
               "PRINT_FILE": "본문출력파일", "ATTACHMENT": "첨부"}
FILE_KINDS = ("PRINT_FILE", "ATTACHMENT")
RETRY_STATUSES = ("DOWNLOAD_FAILED", "TYPE_MISMATCH")
MAX_FILE_BYTES = 30 * 1024 * 1024
MAX_TEXT_CHARS = 150_000
NOTICE_FILE = r"(?i)\.(pdf|hwp|hwpx)\s*$"
MAGIC = {"hwp": "D0CF11E0A1B11AE1", "hwpx": "504B0304"}
TARGET_TAGS = ("소상공인", "창업벤처")
FOOD_EXCLUSION = "음식|외식|식당|요식|카페|커피|제과|베이커리"
OFFICIAL_SUFFIXES = ("bizinfo.go.kr", "mss.go.kr", "k-startup.go.kr", "seoul.go.kr", "seoulcareerup.or.kr", "kinfa.or.kr",
                     "semas.or.kr", "sbiz.or.kr", "seoulshinbo.co.kr", "seoulcredit.co.kr", "sba.seoul.kr", "startup.go.kr")
STRICT_PERIOD = r"^(\d{4}-\d{2}-\d{2})\s*~\s*(\d{4}-\d{2}-\d{2})$"
OPEN_ENDED = ("소진", "마감", "상시", "까지")
UNTIL = "까지"
TILDES = "~∼～"
PERIOD_LABELS = ("접수기간", "신청기간")
CLOSED_WORDS = "마감|종료"
LOAN_CATEGORY = "정책자금"
OPEN_WORD = "접수중"
# Dates are spelled year, month, day, with a unit word or a mark behind each; the year may be short behind
# an apostrophe or be missing. Amounts are counts of units, the largest first.
AFTER_YEAR, AFTER_MONTH, AFTER_DAY = ("년", ".", "-"), ("월", ".", "-"), ("일", ".")
AFTER_SHORT_MONTH = ("월", ".")
APOSTROPHES = "‘’'`"
AMOUNT_UNITS = (("억", 100_000_000), ("천", 10_000_000), ("백", 1_000_000), ("만", 10_000))
NOTICE_SUFFIX = r"(?:\((?:직접대출|대리대출|일반)\))*(?:직접대출|대리대출)?(?:접수|신청)안내"


# ---------------------------------------------------------------- periods and amounts

def real_date(text: Column) -> Column:
    """DATE of an ISO text that exists in the calendar, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_period_strict(raw: Column) -> Column:
    """``struct(start, end)`` of ``D ~ D`` with real dates in order, else null."""
    t = F.trim(raw)
    a, b = real_date(F.regexp_extract(t, STRICT_PERIOD, 1)), real_date(F.regexp_extract(t, STRICT_PERIOD, 2))
    return F.when(a <= b, F.struct(a.alias("start"), b.alias("end")))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), real_date(text))


def _any_of(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def _pieces(text: Column) -> Column:
    """``struct(numbers, gaps)``: the digit runs of a text and what stands before, between and after them."""
    return F.struct(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)).alias("numbers"), F.split(text, r"\d+").alias("gaps"))


def _dates(p: Column) -> Column:
    """Dates in the pieces of a text, from left to right: array of struct(y, m, d, last number used), y null where none is written.

    Three neighbouring numbers are a date if the gaps between them are the signs of year and month;
    two are a month and a day if their gap is a month's and a day's sign follows.
    """
    def small(i: Column) -> Column:
        return F.length(F.get(p["numbers"], i)) <= 2

    def gap(i: Column) -> Column:
        return F.trim(F.get(p["gaps"], i))

    def number(i: Column) -> Column:
        return F.get(p["numbers"], i).try_cast("int")

    def at(i: Column) -> Column:
        digits, before = F.length(F.get(p["numbers"], i)), F.get(p["gaps"], i)
        behind = F.right(before, F.lit(1)).isin(*APOSTROPHES)
        year = F.when(digits == 4, number(i)).when((digits == 2) & behind, number(i) + 2000)
        full = year.isNotNull() & small(i + 1) & small(i + 2) & gap(i + 1).isin(*AFTER_YEAR) & gap(i + 2).isin(*AFTER_MONTH)
        short = small(i) & small(i + 1) & gap(i + 1).isin(*AFTER_SHORT_MONTH) & F.left(F.ltrim(F.get(p["gaps"], i + 2)), F.lit(1)).isin(*AFTER_DAY)
        none = F.lit(None).cast("int")
        return (F.when(F.coalesce(full, F.lit(False)), F.struct(year.alias("y"), number(i + 1).alias("m"), number(i + 2).alias("d"), (i + 2).alias("last")))
                 .when(F.coalesce(short, F.lit(False)), F.struct(none.alias("y"), number(i).alias("m"), number(i + 1).alias("d"), (i + 1).alias("last"))))

    def take(found: Column, i: Column) -> Column:
        """Numbers inside a date already found begin none."""
        used = F.coalesce(F.try_element_at(found, F.lit(-1))["last"], F.lit(-1))
        return F.when(i > used, F.array_compact(F.concat(found, F.array(at(i))))).otherwise(found)

    # Without a number the sequence is the single place 0, where there is none either.
    places = F.sequence(F.lit(0), F.greatest(F.size(p["numbers"]) - 1, F.lit(0)))
    return F.aggregate(places, F.array().cast("array<struct<y:int,m:int,d:int,last:int>>"), take)


def _after_tilde(p: Column, last: Column) -> Column:
    """What stands behind the first tilde after a number, trimmed; null without one."""
    rest = F.array_join(F.transform(F.sequence(last + 1, F.size(p["numbers"])), lambda k: F.concat(F.get(p["gaps"], k), F.coalesce(F.get(p["numbers"], k), F.lit("")))), "")
    sides = F.split(rest, f"[{TILDES}]", 2)
    return F.nullif(F.trim(F.get(sides, F.lit(1))), F.lit(""))


def _is_time(text: Column) -> Column:
    """One time of day, perhaps with the word for "until", and nothing else but marks."""
    def told(p: Column) -> Column:
        behind = F.ltrim(F.get(p["gaps"], F.lit(2)))
        behind = F.when(behind.startswith(UNTIL), F.substring(behind, len(UNTIL) + 1, F.length(behind))).otherwise(behind)
        hour, minute = (F.length(F.get(p["numbers"], F.lit(i))) for i in (0, 1))
        return ((F.size(p["numbers"]) == 2) & (F.get(p["gaps"], F.lit(0)) == "") & (F.get(p["gaps"], F.lit(1)) == ":") & (hour <= 2) & (minute == 2)
                & (F.translate(behind, " ,.)", "") == ""))

    return let(_pieces(text), told)


def parse_period(raw: Column) -> Column:
    """``struct(start, end, note)`` of a free period text with one or two dates, else null.

    The first date has to tell its year. A second one without a year that would fall before the first
    is in the next year; a single one needs either a time range behind it (a single day) or words for
    an open end, which become the note.
    """
    no_text, no_date = F.lit(None).cast("string"), F.lit(None).cast("date")

    def period(start: Column, end: Column, note: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), note.alias("note"))

    def two_dates(x: Column) -> Column:
        this, following = (_ymd(x["a"]["y"] + k, x["b"]["m"], x["b"]["d"]) for k in (0, 1))
        told = _ymd(x["b"]["y"], x["b"]["m"], x["b"]["d"])
        end = F.when(x["b"]["y"].isNotNull(), told).when(this >= x["start"], this).when(this.isNotNull(), following)
        return let(F.struct(x["start"].alias("start"), end.alias("end")), lambda y: F.when(y["end"] >= y["start"], period(y["start"], y["end"], no_text)))

    def one_date(x: Column) -> Column:
        tail = _after_tilde(x["p"], x["a"]["last"])
        return let(F.struct(x["start"].alias("start"), tail.alias("tail")), lambda y: F.when(_is_time(y["tail"]), period(y["start"], y["start"], no_text)).when(
            ~y["tail"].rlike(r"\d") & _any_of(y["tail"], OPEN_ENDED), period(y["start"], no_date, y["tail"])))

    def decide(x: Column) -> Column:
        first = F.get(x["dates"], F.lit(0))
        bound = F.struct(x["p"].alias("p"), F.size(x["dates"]).alias("n"), first.alias("a"), F.get(x["dates"], F.lit(1)).alias("b"),
                         _ymd(first["y"], first["m"], first["d"]).alias("start"))
        return let(bound, lambda y: F.when(y["start"].isNotNull() & (y["n"] == 2), two_dates(y)).when(
            y["start"].isNotNull() & (y["n"] == 1), one_date(y)))

    return let(_pieces(F.trim(F.regexp_replace(raw, r"\s+", " "))), lambda p: let(F.struct(p.alias("p"), _dates(p).alias("dates")), decide))


def parse_single_amount(raw: Column) -> Column:
    """Amount words to won, only when the whole cell is one amount.

    The units come in falling order, each once at most; thousands and hundreds count ten thousands and
    so need that unit, which may stand without a count behind them.
    """
    t = compact(raw)
    counts = {unit: F.nullif(F.regexp_extract(t, rf"(\d+){unit}", 1), F.lit("")) for unit, _ in AMOUNT_UNITS}
    spelled, won = F.lit(""), F.lit(0).cast("bigint")
    large = counts["천"].isNotNull() | counts["백"].isNotNull()
    for unit, worth in AMOUNT_UNITS:
        bare = F.when(large, F.lit(unit)).otherwise("") if unit == "만" else F.lit("")
        spelled = F.concat(spelled, F.coalesce(F.concat(counts[unit], F.lit(unit)), bare))
        won = won + F.coalesce(counts[unit].try_cast("bigint"), F.lit(0)) * worth
    # the cell must be what its own counts spell, so nothing else stands in it
    return F.when((t == F.concat(spelled, F.lit("원"))) & (won > 0), won)


# ---------------------------------------------------------------- hosts and files

def official_url(url: Column, suffixes: Sequence[str] = OFFICIAL_SUFFIXES) -> Column:
    """https with a host equal to, or below, an allowed suffix."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    below = F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: (host == s) | host.endswith(F.concat(F.lit("."), s)))
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & below, F.lit(False))


def file_type(name: Column, content: Column) -> Column:
    """PDF / HWP / HWPX when extension and leading bytes agree, else null."""
    ext = F.lower(F.regexp_extract(name, r"(?i)\.([a-z0-9]+)\s*$", 1))
    head = F.hex(F.substring(content, 1, 1024))
    pdf = F.decode(F.substring(content, 1, 1024), "ISO-8859-1").contains("%PDF-")
    return (F.when((ext == "pdf") & pdf, "PDF")
             .when((ext == "hwp") & head.startswith(MAGIC["hwp"]), "HWP")
             .when((ext == "hwpx") & head.startswith(MAGIC["hwpx"]), "HWPX"))


def drop_query_parameter(url: Column, name: str) -> Column:
    """URL without one query parameter."""
    out = F.regexp_replace(url, rf"([?&]){name}=[^&#]*&?", "$1")
    return F.regexp_replace(out, r"[?&](?=$|#)", "")


def split_files(df: DataFrame, paths: str, names: str, volatile: str = "downloadToken") -> DataFrame:
    """Paired ``@`` lists -> one row per file; names are dropped when the list sizes differ."""
    def parts(c: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "@"), lambda x: F.trim(x)), lambda x: x != "")

    d = df.withColumns({"_p": parts(paths), "_n": parts(names)})
    paired = F.size("_p") == F.size("_n")
    rows = d.select(*[c for c in df.columns if c not in (paths, names)], "_n", paired.alias("paired"), F.posexplode("_p").alias("ord", "path"))
    return rows.select(*[c for c in rows.columns if c not in ("_n", "path")],
                       F.when(F.col("paired"), F.get("_n", F.col("ord"))).otherwise(F.lit("")).alias("name"),
                       drop_query_parameter(F.col("path"), volatile).alias("url"))


# ---------------------------------------------------------------- text assembly

def part_statuses(parts: DataFrame, notice: str = "notice_id") -> DataFrame:
    """Status per part of a notice.

    ``parts``: notice, ord, kind, name, url, text, fetch (OK / FAILED / TRANSIENT for files),
    bytes. A file whose content was already seen in the notice is DUPLICATE: the first
    position per (notice, checksum) is a map-side combined minimum over narrow columns.
    """
    p = parts.withColumn("text", normalise_text(F.coalesce("text", F.lit(""))))
    is_file = F.col("kind").isin(*FILE_KINDS)
    usable = is_file & F.col("name").rlike(NOTICE_FILE) & (F.col("fetch") == "OK") & (F.col("bytes") <= MAX_FILE_BYTES)
    p = p.withColumns({"checksum": F.when(~is_file | (F.col("fetch") == "OK"), F.sha2("text", 256)), "_usable": usable})
    firsts = p.where("_usable").groupBy(notice, "checksum").agg(F.min("ord").alias("_first"))
    j = p.join(firsts, [notice, "checksum"], "left")
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    status = (F.when(~is_file, F.when(blank, "NO_TEXT").otherwise("READ"))
              .when(~F.col("name").rlike(NOTICE_FILE), "UNSUPPORTED_TYPE").when(F.col("fetch") == "TRANSIENT", "TRANSIENT")
              .when(F.col("fetch") == "FAILED", "DOWNLOAD_FAILED").when(F.col("bytes") > MAX_FILE_BYTES, "TOO_LARGE")
              .when(F.col("ord") > F.col("_first"), "DUPLICATE").when(blank, "NO_TEXT").otherwise("READ"))
    return j.withColumn("status", status).drop("_usable", "_first")


def assemble(statuses: DataFrame, notice: str = "notice_id") -> DataFrame:
    """One text per notice: a header line per read part, parts joined by a blank line.

    The text of a notice is one value, so its parts meet in one row by definition. A notice
    with a part that could not be fetched this time is INCOMPLETE and has no text.
    """
    label = None
    for k, v in KIND_LABELS.items():
        label = F.when(F.col("kind") == k, F.lit(v)) if label is None else label.when(F.col("kind") == k, F.lit(v))
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    section = F.concat(F.lit("["), label, F.lit(": "), F.col("name"), F.lit("]\n"), trimmed)
    read = F.col("status") == "READ"
    # the section is only shuffled for parts that are read; other parts travel as a status
    rows = statuses.select(notice, "ord", "status", F.when(read, section).alias("_s"))
    g = rows.groupBy(notice).agg(
        F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("ord", "_s")))).alias("_parts"),
        F.max((F.col("status") == "TRANSIENT").cast("int")).alias("_transient"),
        F.max(F.col("status").isin(*RETRY_STATUSES).cast("int")).alias("_retry"),
        F.count(F.lit(1)).alias("document_count"))
    text = normalise_text(F.array_join(F.transform("_parts", lambda x: x["_s"]), "\n\n"))
    status = F.when(F.col("_transient") == 1, "INCOMPLETE").when(F.size("_parts") == 0, "NO_TEXT").otherwise("COMPLETE")
    out = g.select(notice, status.alias("outcome"), text.alias("text"), (F.col("_retry") == 0).alias("settled"), "document_count")
    return out.withColumn("text", F.when(F.col("outcome") == "COMPLETE", F.col("text"))).withColumn("checksum", F.sha2("text", 256))


def plan_signature(parts: DataFrame, notice: str = "notice_id") -> DataFrame:
    """Fingerprint of what can be compared before files are fetched: inline content, file addresses."""
    is_file = F.col("kind").isin(*FILE_KINDS)
    cols = parts.select(notice, "ord", "kind", "url", F.when(~is_file, F.sha2(normalise_text(F.coalesce("text", F.lit(""))), 256)).alias("checksum"))
    return multiset_fingerprint(cols, ["ord", "kind", "url", "checksum"], by=[notice]).select(notice, F.col("fingerprint").alias("signature"))


def resolve_text(built: DataFrame, signatures: DataFrame, previous: DataFrame, notice: str = "notice_id") -> DataFrame:
    """REUSED / STORED / NO_TEXT / INCOMPLETE per notice.

    ``previous``: notice, previous_checksum, previous_signature, previous_settled.
    """
    j = built.join(signatures, notice).join(previous, notice, "left")
    same = F.coalesce(F.col("previous_settled") & (F.col("previous_signature") == F.col("signature")), F.lit(False))
    outcome = (F.when(same, "REUSED").when(F.col("outcome") == "INCOMPLETE", "INCOMPLETE")
               .when(F.col("outcome") == "NO_TEXT", "NO_TEXT").otherwise("STORED"))
    kept = F.when(same | (F.col("outcome") == "INCOMPLETE"), F.col("previous_checksum")).otherwise(F.col("checksum"))
    return j.select(notice, outcome.alias("text_outcome"), F.when(outcome != "NO_TEXT", kept).alias("text_checksum"))


# ---------------------------------------------------------------- selection and status

def select_notices(df: DataFrame, as_of: str, tags: Sequence[str] = TARGET_TAGS) -> DataFrame:
    """Add ``skip``: MALFORMED, DUPLICATE, NOT_TARGET, ENDED, or null for a kept notice.

    Columns: notice_id, line, name, url, organization, target, period. The first well-formed
    row of an id wins.
    """
    ok_shape = (F.length("name") >= 2) & official_like(F.col("url")) & (F.length("organization") >= 2) & F.col("notice_id").isNotNull()
    d = df.withColumn("_ok", F.coalesce(ok_shape, F.lit(False)))
    firsts = d.where("_ok").groupBy("notice_id").agg(F.min("line").alias("_first"))
    j = d.join(firsts, "notice_id", "left")
    tagged = F.greatest(*[F.col("target").contains(t).cast("int") for t in tags]) == 1 if len(tags) > 1 else F.col("target").contains(tags[0])
    end = parse_period_strict(F.col("period"))["end"]
    return j.withColumn("skip", first_reason([
        ("MALFORMED", ~F.col("_ok")), ("DUPLICATE", F.col("line") > F.col("_first")), ("NOT_TARGET", missing_or(tagged)),
        ("ENDED", end < F.lit(as_of).cast("date"))])).drop("_ok", "_first")


def official_like(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://"), F.lit(False))


def resolve_status(df: DataFrame, as_of: str) -> DataFrame:
    """Application status out of the page mark and both periods; any conflict makes it UNKNOWN.

    Columns: card_status (null without a card), card_period, notice_period (texts).
    """
    day = F.lit(as_of).cast("date")
    head = F.substring_index(F.translate("card_period", "：", ":"), ":", 1)
    labelled = (F.length(head) < F.length("card_period")) & F.regexp_replace(head, r"\s", "").isin(*PERIOD_LABELS)
    label = F.trim(F.when(labelled, F.substring(F.col("card_period"), F.length(head) + 2, F.length("card_period"))).otherwise(F.col("card_period")))
    d = df.withColumns({"_label": label, "_c": parse_period(label), "_n": parse_period(F.col("notice_period"))})
    c, n = F.col("_c"), F.col("_n")
    start0 = F.coalesce(c["start"], n["start"])
    narrower = n["end"].isNotNull() & (c.isNull() | (n["start"] == c["start"]))
    end0 = F.coalesce(c["end"], F.when(narrower, n["end"]))
    reversed_ = F.coalesce(end0 < start0, F.lit(False))
    start, end = F.when(~reversed_, start0), F.when(~reversed_, end0)
    status = compact(F.col("card_status"))
    conflicts = issue_array([
        ("PERIOD_UNREADABLE", c.isNull() & F.coalesce(F.col("_label").rlike(r"\d"), F.lit(False))),
        ("START_DIFFERS", F.coalesce(c["start"] != n["start"], F.lit(False))),
        ("END_DIFFERS", F.coalesce(c["end"] != n["end"], F.lit(False))),
        ("END_BEFORE_START", reversed_),
        ("STARTS_LATER", F.coalesce(start > day, F.lit(False)) & (status == OPEN_WORD)),
        ("ENDED_BEFORE", F.coalesce(end < day, F.lit(False)) & (status == OPEN_WORD)),
        ("NOT_OPEN_MARK", ~status.rlike(CLOSED_WORDS) & (status != OPEN_WORD))])
    no_card = F.col("card_status").isNull()
    out = d.withColumns({
        "conflicts": F.when(no_card, F.array(F.lit("NO_CARD"))).otherwise(conflicts),
        "period_start": F.when(no_card, n["start"]).otherwise(start), "period_end": F.when(no_card, n["end"]).otherwise(end)})
    final = (F.when(no_card, "UNKNOWN").when(status.rlike(CLOSED_WORDS), "CLOSED")
             .when((status == OPEN_WORD) & (F.size("conflicts") == 0), "OPEN").otherwise("UNKNOWN"))
    return out.withColumn("application_status", final).drop("_label", "_c", "_n")


def downgrade_status(status: Column, lines: Column, pattern: str = FOOD_EXCLUSION) -> Column:
    """An exclusion signal may only turn OPEN into UNKNOWN."""
    signal = F.exists(lines, lambda x: x.rlike(pattern))
    return F.when((status == "OPEN") & F.coalesce(signal, F.lit(False)), "UNKNOWN").otherwise(status)


# ---------------------------------------------------------------- fund names

def normal_fund_name(name: Column) -> Column:
    return F.regexp_replace(compact(name), "^소상공인", "")


def fund_id(section: Column, name: Column) -> Column:
    return F.concat(section, F.lit(":"), normal_fund_name(name))


def fund_key(section: Column, name: Column, prefix: str = "fund-") -> Column:
    kind = F.when(section == "직접대출", "direct").otherwise("agency")
    return F.concat(F.lit(prefix), kind, F.lit("-"), F.substring(F.sha2(fund_id(section, name), 256), 1, 10))


def title_matches(fund: Column, title: Column) -> Column:
    """The title holds the normalised fund name followed only by allowed suffixes and an application notice."""
    pattern = F.concat(F.lit(r"\Q"), fund, F.lit(r"\E"), F.lit(NOTICE_SUFFIX))
    return (F.length(fund) > 0) & F.rlike(compact(title), pattern)


def latest_notice(funds: DataFrame, notices: DataFrame, category: str = LOAN_CATEGORY) -> DataFrame:
    """Newest matching notice per (section, fund); only notices of the loan category announce a fund.

    No fund meets every notice: a matching fund name ends where the allowed suffix starts, so a
    title is cut into the few names it could announce, and those meet the funds in an equi-join.
    Equal titles are cut once, and equal names keep only the newest number before they are
    shuffled; the titles of the numbers found are looked up afterwards.
    """
    f = funds.select("section", "fund_name", normal_fund_name(F.col("fund_name")).alias("_fund")).distinct()
    n = notices.withColumn("_t", compact(F.col("title"))).where((F.length("_t") > 1) & (F.col("category") == category))
    ends = F.filter(F.sequence(F.lit(2), F.length("_t")),
                    lambda i: F.substring(F.col("_t"), i, F.length("_t")).rlike("^" + NOTICE_SUFFIX))
    cut = n.groupBy("section", "_t").agg(F.max("seq").alias("seq")).withColumn("_end", F.explode(ends))
    names = cut.withColumn("_start", F.explode(F.sequence(F.lit(1), F.col("_end") - 1))).select(
        "section", "seq", F.substring(F.col("_t"), F.col("_start"), F.col("_end") - F.col("_start")).alias("_fund"))
    hits = names.groupBy("section", "_fund").agg(F.max("seq").alias("seq")).join(f, ["section", "_fund"])
    newest = hits.groupBy("section", "fund_name").agg(F.max("seq").alias("seq"), F.any_value("_fund").alias("_fund"))
    # of equal numbers the greatest title that announces the fund
    size = F.length("_fund")
    announces = F.exists(ends, lambda i: (i > size) & (F.substring(F.col("_t"), i - size, size) == F.col("_fund")))
    titles = (n.select("section", "seq", "title", "_t").join(newest, ["section", "seq"]).where(announces)
              .groupBy("section", "fund_name").agg(F.max("title").alias("title")))
    return newest.drop("_fund").join(titles, ["section", "fund_name"], "left")
