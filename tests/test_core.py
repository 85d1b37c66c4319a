"""Hand-made cases: quarters, money, ranks, windows, finance, texts."""

import random

import pytest
from pyspark.sql import functions as F

from placemetrics.functions import quarter as Q
from placemetrics.functions import ranks as RK
from placemetrics.functions import text as TX
from placemetrics.functions.hashing import multiset_fingerprint
from placemetrics.functions.money import half_up_div
from placemetrics.operators import finance as FI
from placemetrics.operators import notices as N
from placemetrics.operators import quality as D
from placemetrics.operators import survival as S

SALES = "area_type string, area_code string, industry_code string, quarter_idx int, sales_amount bigint, similar_store_count int, " \
        "franchise_store_count int, closed_store_count int, opened_store_count int"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_quarters(spark):
    r = one(spark, Q.shift_quarter(F.lit("20211"), -4).alias("a"), Q.shift_quarter(F.lit("20211"), -1).alias("b"),
            Q.shift_quarter(F.lit("20244"), 1).alias("c"), Q.quarter_idx(F.lit("20215")).alias("d"),
            Q.quarters_between(F.lit(8084), F.lit(8083)).alias("e"),
            Q.quarter_code(Q.quarter_at(F.lit("2024-03-31 16:00:00").cast("timestamp"))).alias("f"))
    assert list(r) == ["20201", "20204", "20251", None, [], "20242"]


def test_money_and_revenue(spark):
    r = one(spark, S.monthly_revenue(F.lit(53041346765), F.lit(499)).alias("a"), S.monthly_revenue(F.lit(184219542), F.lit(11)).alias("b"),
            half_up_div(F.lit(-5), F.lit(2)).alias("c"), half_up_div(F.lit(5), F.lit(0)).alias("d"), half_up_div(F.lit(None).cast("bigint"), F.lit(3)).alias("e"))
    assert list(r) == [35431761, 5582410, -3, None, None]


def test_ranks_and_quantiles(spark):
    scores = spark.createDataFrame([("x", 90), ("x", 80), ("x", 80), ("x", 70)], "g string, s int")
    got = sorted((r.s, r["rank"]) for r in RK.competition_rank(scores, ["g"], "s").collect())
    assert got == [(70, 4), (80, 2), (80, 2), (90, 1)]
    v = spark.range(1, 201).select(F.lit("x").alias("g"), F.col("id").alias("v"))
    q = RK.nearest_rank(v, ["g"], "v", {"lo": 0.01, "hi": 0.99}).first()
    assert (q.lo, q.hi, q.n) == (2, 198, 200)


def test_running_totals_with_a_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"g{i % 40}", rnd.randint(0, 500), rnd.randint(1, 5)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v int, m int").groupBy("g", "v").agg(F.sum("m").alias("m"))
    want = {}
    for g in {r[0] for r in rows}:
        sums = {}
        for _, v, m in (r for r in rows if r[0] == g):
            sums[v] = sums.get(v, 0) + m
        total, run = sum(sums.values()), 0
        for v in sorted(sums):
            run += sums[v]
            want[g, v] = (run, total)
    for target in (None, 1_000, 30, 1):
        assert {(r.g, r.v): (r.cum_m, r.total_m) for r in RK.running_totals(df, ["g"], "v", ["m"], target).collect()} == want


def test_no_range_is_over_the_target(spark):
    # A third of the rows are one group, half of its values stand close together, and one value is in every group.
    rows = [("hot", v) for v in range(3000)] + [("hot", 1e9 + v / 1e3) for v in range(3000)] + [(f"g{k}", 5.0) for k in range(5000)] + [(f"g{k}", 7e8 + k) for k in range(5000)]
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    for target in (500, 40):
        ranged = RK.into_ranges(df, ["g"], "v", target)
        assert ranged.groupBy("g", "_range").count().agg(F.max("count")).first()[0] <= target
        spans = ranged.groupBy("_range").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_range").collect()
        assert all(x.b < y.a for x, y in zip(spans, spans[1:]))
    assert RK.into_ranges(df, ["g"], "v").select("_range").distinct().count() == 1


def test_positions(spark):
    df = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    got = [r.k for r in RK.positions(df, "k").orderBy("position").collect()]
    assert got == sorted(got) and RK.positions(df, "k").agg(F.max("position")).first()[0] == 2999
    assert RK.positions(df, "k", target=100).orderBy("position").select("k").collect() == RK.positions(df, "k").orderBy("position").select("k").collect()


def test_windows_see_gaps(spark):
    full = [("A", "1", "c", q, 100, 10, 1, 1, 2) for q in range(8000, 8012)]
    gap = [("A", "2", "c", q, 100, 10, 1, 1, 2) for q in range(8000, 8012) if q != 8006]
    null = [("A", "3", "c", q, None if q == 8006 else 100, 10, None if q == 8007 else 1, 1, 2) for q in range(8000, 8012)]
    f = S.build_features(spark.createDataFrame(full + gap + null, SALES))
    at = {(r.area_code, r.quarter_idx): r for r in f.collect()}
    assert at["1", 8006].reason is None and at["1", 8006].past_closure_rate == pytest.approx(0.4)
    assert at["2", 8008].reason == "INCOMPLETE_WINDOW" and at["2", 8010].reason == "NO_PRIOR_SALES"
    assert at["3", 8008].reason == "INCOMPLETE_WINDOW" and at["3", 8006].reason == "NO_SALES"
    assert at["3", 8007].reason == "INCOMPLETE_WINDOW" and at["1", 8003].reason == "NO_PRIOR_SALES"
    assert at["1", 8007].future_closure_rate == pytest.approx(0.4) and at["1", 8008].future_closure_rate is None


def test_auc_needs_both_classes(spark):
    good = spark.createDataFrame([("i", 0.1, 0), ("i", 0.4, 1), ("i", 0.4, 0), ("i", 0.9, 1)], "industry_code string, p double, label int")
    assert S.auc(good, ["industry_code"], "p", "label").first().auc == pytest.approx(0.875)
    assert S.ks(good, ["industry_code"], "p", "label").first().ks == pytest.approx(0.5)
    with pytest.raises(Exception, match="both classes"):
        S.auc(good.where("label = 1"), ["industry_code"], "p", "label").collect()


PLAN = "plan_id int, loan_principal bigint, annual_rate decimal(18,6), total_months int, grace_months int, repayment_method string"


def test_loans(spark):
    from decimal import Decimal as Dec
    rows = [(1, 50_000_000, Dec(5), 60, 0, "EQUAL_PAYMENT"), (2, 100, Dec(0), 3, 0, "EQUAL_PRINCIPAL"), (3, 100, Dec(1), 3, 3, "EQUAL_PRINCIPAL"),
            (4, 100, None, 3, 0, None), (5, 0, None, None, None, None), (6, 1000, Dec(12), 4, 2, "EQUAL_PAYMENT")]
    out = {r.plan_id: r for r in FI.loan_summary(FI.with_loan(spark.createDataFrame(rows, PLAN))).collect()}
    assert out[1].first_payment == 943_562 and out[1].schedule[-1].remaining == 0 and out[1].total_principal == 50_000_000
    assert [m.principal for m in out[2].schedule] == [33, 33, 34]
    assert out[3].loan.status == "UNSUPPORTED" and out[3].schedule is None
    assert out[4].loan.missing_fields == ["newLoan.annualInterestRatePercent", "newLoan.repaymentMethod"]
    assert out[5].loan.status == "READY" and out[5].first_payment == 0
    assert [m.payment for m in out[6].schedule][:2] == [10, 10]


def test_cells(spark):
    cells = ["", " 007 ", "-5", "1x", "UNSAFE:1", "1234567890123456789"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(D.parse_amount(F.col("c")).alias("r")).collect()
    assert [(r.r.issue, None if r.r.value is None else int(r.r.value)) for r in df] == [
        ("NON_NUMERIC_AMOUNT", None), (None, 7), ("NEGATIVE_AMOUNT", None), ("NON_NUMERIC_AMOUNT", None), ("NON_NUMERIC_AMOUNT", None), ("NON_NUMERIC_AMOUNT", None)]


def test_dedupe_and_ledger(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z"), ("a", 5, "w")], "k string, line int, v string")
    assert sorted((r.k, r.line, r.v, r.copies) for r in D.dedupe_first(df, ["k"], ["line"]).collect()) == [("a", 1, "x", 3), ("b", 3, "z", 1)]
    assert sorted(r.line for r in D.later_duplicates(df, ["k"], ["line"]).collect()) == [2, 5]
    many = spark.range(200).select(F.lit("C").alias("code"), F.col("id").alias("line"))
    led = D.issue_ledger(many, "line").first()
    assert led.issue_count == 200 and led.examples == list(range(50))
    with pytest.raises(D.ValidationFailed, match="C 200"):
        D.fail_if_errors(D.issue_ledger(many, "line"))


def test_fingerprint_counts_copies_and_ignores_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "a string, b int")
    b = spark.createDataFrame([("y", 2), ("x", 1), ("x", 1)], "a string, b int")
    c = spark.createDataFrame([("y", 2), ("x", 1)], "a string, b int")
    fp = [multiset_fingerprint(d, ["a", "b"]).first().fingerprint for d in (a, b, c)]
    assert fp[0] == fp[1] != fp[2]


def test_texts(spark):
    r = one(spark, TX.decode_entities(F.lit("&amp;lt; &#38;amp; &lt;b&gt; &#xAC00; &copy; &#0; a&b")).alias("a"),
            TX.html_to_lines(F.lit("&lt;p class=&quot;x&quot;&gt;A&lt;/p&gt;B &lt; 10 &gt;<br/> <li>C</li>\n\n")).alias("b"),
            TX.compact_quote(F.lit("Ａ ㆍ〜​1")).alias("c"), TX.normalise_text(F.lit("a\r\nb\rc\u0001\td")).alias("d"),
            TX.mask_secret(F.lit("k=a%2Bb; a+b; a%252Bb"), "a%2Bb").alias("e"))
    assert r.a == "&lt; &amp; <b> 가 &copy;  a&b"
    assert r.b == ["A", "B < 10 >", "C"]
    assert r.c == "A·~1" and r.d == "a\nb\nc\td" and r.e == "k=***; ***; ***"


def test_periods(spark):
    cases = [("‘25. 12. 28.(일) ~ 1. 5.(월)", "2025-12-28", "2026-01-05", None), ("2027-03-02 ~ 한도 소진 시", "2027-03-02", None, "한도 소진 시"),
             ("2027년 3월 2일 ~ 2027년 4월 1일", "2027-03-02", "2027-04-01", None), ("`27년3월2일~4월1일", "2027-03-02", "2027-04-01", None),
             ("2027. 3. 2 (화)  9:00 ∼ 12:00까지 ,", "2027-03-02", "2027-03-02", None), ("'27-03-02 ～ 18:00", "2027-03-02", "2027-03-02", None),
             ("2027.3.2.~상시", "2027-03-02", None, "상시"), ("2028. 2. 1. ~ 2. 29.", "2028-02-01", "2028-02-29", None)]
    none = ["2026-02-30 ~ 2026-03-01", "2026. 10. 6. 10:00", "상시", "", "2026-01-05 ~ 2026-01-01", "27-03-02 ~ 상시", "3. 2. ~ 4. 1.", "2027. 3. 2. ~ 7일간", "2027. 3. 2. ~ 10:00 ~ 12:00",
            "2027. 2. 1. ~ 2. 29.", "2027-03-02 ~ 2027-03-05, 2027-04-01 ~ 2027-04-05", "2027-03-022 ~ 상시", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([c[0] for c in cases] + none)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", N.parse_period(F.col("t")).alias("p")).collect()}
    for i, (text, start, end, note) in enumerate(cases):
        assert got[i] is not None and (str(got[i].start), got[i].end and str(got[i].end), got[i].note) == (start, end, note), text
    assert [t for i, t in enumerate(none) if got[len(cases) + i] is not None] == []


def test_amounts_and_titles(spark):
    r = one(spark, N.parse_single_amount(F.lit("1억 4백만원")).alias("a"), N.parse_single_amount(F.lit("7천만원")).alias("b"), N.parse_single_amount(F.lit("1억원, 2억원")).alias("c"),
            N.title_matches(F.lit("aa"), F.lit("aaa 접수 안내")).alias("d"), N.title_matches(F.lit("대환대출"), F.lit("대환대출(피해) 접수안내")).alias("e"),
            N.official_url(F.lit("https://www.sbiz.or.kr/x")).alias("f"), N.official_url(F.lit("https://evilsbiz.or.kr/x")).alias("g"))
    assert list(r) == [104_000_000, 70_000_000, None, True, False, True, False]


def test_fraction_stays_text(spark):
    from placemetrics.operators.quality import api_number_cell, parse_amount
    r = spark.sql("SELECT CAST(1.5 AS DOUBLE) AS a, CAST(7 AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS c")
    got = r.select(api_number_cell(F.col("a")).alias("a"), api_number_cell(F.col("b")).alias("b"), api_number_cell(F.col("c")).alias("c"),
                   parse_amount(api_number_cell(F.col("a")))["issue"].alias("d")).first()
    assert tuple(got) == ("1.5", "7", "", "NON_NUMERIC_AMOUNT")


def test_unknown_case_and_table(spark):
    from placemetrics.operators.grading import known_cases
    from placemetrics.operators.rent import parse_rent
    runs, cases = spark.createDataFrame([(1,), (9,)], "k long"), spark.createDataFrame([(1,)], "k long")
    with pytest.raises(Exception, match="unknown case 9"):
        known_cases(runs, cases, "k").collect()
    rows = spark.createDataFrame([("nope", "g", "c", "c", "202101", "1", "i", "u")], "table_id string, group_name string, class_name string, class_name_full string, period string, value_text string, item_name string, unit_name string")
    defs = spark.createDataFrame([], "table_id string, building string, metric string, item string, unit string")
    assert [r.issue for r in parse_rent(rows, defs, "root").collect()] == ["UNKNOWN_TABLE"]


def test_rates_keep_all_digits(spark):
    from placemetrics.operators.finance import rate_units
    assert spark.sql("SELECT CAST('3.123456789012345678' AS DECIMAL(21,18)) AS r").select(rate_units(F.col("r")).alias("u")).first().u == 3123456789012345678


def test_header_of_every_file(spark, tmp_path):
    from placemetrics.sources.tabular import HeaderMismatch, TableSchema, read_versioned
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n4,3\n")
    rows, bad = read_versioned(spark, str(tmp_path), TableSchema({"x": "p", "y": "q"}))
    assert sorted(map(tuple, rows.select("p", "q").collect())) == [("1", "2"), ("3", "4")] and bad.count() == 0
    (tmp_path / "c.csv").write_text("x,z\n1,2\n")
    with pytest.raises(HeaderMismatch):
        read_versioned(spark, str(tmp_path), TableSchema({"x": "p", "y": "q"}))
