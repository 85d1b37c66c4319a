"""Rows are dealt out and combined before they are sorted or shuffled, so that one task holds few of them."""

import contextlib
import io

from pyspark.sql import functions as F

from placemetrics.operators import catalog, grading, notices
from placemetrics.plans import catalog_queries, notice_queries


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_latest_notice_combines_before_it_shuffles(spark):
    funds = spark.createDataFrame([("직접대출", "소상공인 성장 자금"), ("직접대출", "빈 자금"), ("대리대출", "성장자금"), (None, "성장자금")], "section string, fund_name string")
    rows = [("직접대출", 1, "[공지] 성장 자금 신청안내"), ("직접대출", 7, "[공지] 성장 자금 신청안내"), ("직접대출", 7, "새 성장자금(직접대출) 접수 안내"),
            ("직접대출", 7, "다른 일 신청안내"), ("직접대출", 9, "성장 자금 결과"), ("대리대출", None, "성장자금 접수안내"), (None, 3, "성장자금 접수안내"), ("직접대출", 8, None)]
    found = notices.latest_notice(funds, spark.createDataFrame(rows, "section string, seq long, title string").withColumn("category", F.lit(notices.LOAN_CATEGORY)))
    assert sorted(map(tuple, found.select("section", "fund_name", "seq", "title").collect())) == [
        ("대리대출", "성장자금", None, None), ("직접대출", "소상공인 성장 자금", 7, "새 성장자금(직접대출) 접수 안내")]
    text = plan(notice_queries.QUERIES["latest_per_key"](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in text and "REPARTITION_BY_NUM" in text


def test_assign_versions_keeps_its_joins_in_many_tasks(spark):
    products = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "z"), (None, "x")], "product_key string, fingerprint string")
    stored = spark.createDataFrame([("a", "1.0.4", "x", 2), ("a", "1.0.3", "x", 1), ("b", "1.2.9", "w", 0), ("b", "bad", "v", 1)], "product_key string, version string, fingerprint string, line int")
    got = sorted(map(tuple, catalog.assign_versions(products, stored).collect()), key=str)
    assert got == sorted([("a", "x", "1.0.3", True)] * 2 + [("b", "y", "1.2.10", False), ("c", "z", "1.0.0", False), (None, "x", "1.0.0", False)], key=str)
    assert plan(catalog_queries.QUERIES["assign_version"](spark, "/root/testdata/sf0.001")).count("REPARTITION_BY_NUM") >= 3


def test_group_probes_are_asked_once_per_kind(spark):
    rows = [("READ", 20.0, 39.0, False), ("READ", None, 30.0, True), ("READ", None, None, False), ("READ", 130.0, 140.0, False), ("NOT_MENTIONED", None, None, None), (None, None, None, None)]
    ages = spark.createDataFrame(rows, "status string, min double, max double, excl boolean").withColumn("wanted", F.explode(F.array(
        *[F.array(*[F.lit(g) for g in gs]).cast("array<string>") for gs in ((), ("YOUTH",), ("WOMEN",), ("OTHER", "RESTART", "YOUTH"), ("DAMAGED",))])))
    age, day = F.struct("status", "min", "max", "excl"), F.lit(grading.AS_OF).cast("date")
    option = F.struct(F.lit("READ").alias("status"), F.col("wanted").alias("value"))
    probes = [grading.probe_profiles("groups", F.array(option), age, (), kinds=k) for k in (False, True)]
    got = ages.select(*[F.size(p) for p in probes], *[F.sort_array(F.array_distinct(F.transform(p, lambda q: F.struct(
        F.sort_array(q["groups"]).alias("g"), grading.verdict("groups", {"groups": option, "age": age}, q, day).alias("v"))))) for p in probes]).collect()
    assert len(got) == 30 and all(few <= 27 < many and a == b for many, few, a, b in got)
