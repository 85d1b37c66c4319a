"""The pair list against all pairs with their verdicts, on made notices and applicants."""

import datetime

from pyspark.sql import functions as F

from placemetrics.operators import matching as M
from placemetrics.plans import matching_queries as MQ


def notices(spark, n):
    k = (F.xxhash64("id") % 100_003 + 100_003).cast("long")
    rows = spark.range(n).select(
        F.concat(F.lit("n-"), (F.col("id") % (n - 3)).cast("string")).alias("product_key"), F.col("id").alias("position"), F.lit("POLICY_FUND").alias("tab"),
        F.lit("OPEN_CONFIRMED").alias("application_state"), F.when(F.col("id") % 13 == 0, "SOURCE_STATUS").alias("closed_by"),
        F.get(F.array(F.lit("서울"), F.lit("부산"), F.lit("전국"), F.lit(None)), (k % 4).cast("int")).alias("mark"), k.alias("k"),
        *[MQ.reading(c, k + 7 * i).alias(c) for i, c in enumerate(M.CONDITIONS)])
    # districts and groups out of the lists, bounds that are missing or not whole months
    region, age = F.col("region"), F.col("business_age")
    strange = F.array(F.lit("11003"), F.lit("99999"))
    return rows.withColumns({
        "region": F.when(F.col("k") % 4 == 1, region.withField("districts", strange)).when(F.col("k") % 4 == 2, region.withField("ex_districts", strange))
        .when(F.col("k") % 17 == 3, region.withField("ex_provinces", F.array(F.lit("부산")))).otherwise(region),
        "business_age": F.when(F.col("k") % 9 == 1, age.withField("excl", F.lit(None).cast("boolean"))).when(F.col("k") % 9 == 2, age.withField("max", F.lit(0.25))).otherwise(age),
        "groups": F.when(F.col("k") % 5 == 1, F.col("groups").withField("value", F.array(F.lit("DAMAGED"), F.lit(None)))).otherwise(F.col("groups"))}).withColumns(
        {n: F.when(F.col("position") % 3 == 0, F.col(n).withField("status", F.lit("READ"))).otherwise(F.col(n)) for n in M.CONDITIONS}).drop("k")


def applicants(spark, n):
    def pick(i, *values):
        return F.get(F.array(*values), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(values))).cast("int"))

    none = F.lit(None)
    status = pick(1, F.lit("PRE_STARTUP"), F.lit("BUSINESS"), F.lit("BUSINESS"), F.lit("RETIRED"), none.cast("string"))
    opened = pick(2, *[F.lit(m) for m in ("2024-06", "2024-05", "2024-07", "2021-06", "2021-05", "2020-02", "2018-06", "2015-01")], none.cast("string"))
    district = pick(3, *[F.lit(d) for d in ("11003", "11004", "11010", "99999", "88888")], none.cast("string"))
    age = pick(4, *[F.lit(a) for a in (17, 18, 22, 39, 40, 58, 59, 99)], none.cast("int"))
    groups = pick(5, *[F.array(*[F.lit(g) for g in x]).cast("array<string>") for x in ((), ("WOMEN",), ("DISABLED", "RESTART"), ("DAMAGED", None), ("OTHER", "WOMEN"))], none.cast("array<string>"))
    return spark.range(n).select((F.col("id") % (n - 2)).alias("profile_id"), F.struct(
        status.alias("status"), opened.alias("opened"), district.alias("district"), age.alias("age"), groups.alias("groups")).alias("profile"))


def all_pairs(products, profiles):
    v = M.six_verdicts({n: F.col(n) for n in M.CONDITIONS}, F.col("profile"), F.lit(MQ.AS_OF).cast("date"))
    v["region"] = M.apply_title_mark(v["region"], F.col("region.status"), F.col("mark"))
    # a generator keeps Spark from copying the verdicts into the filter and the group
    six = F.explode(F.array(F.struct(*[v[n].alias(f"v_{n}") for n in M.CONDITIONS])))
    every = products.where("closed_by IS NULL").crossJoin(profiles).select("profile_id", "product_key", "tab", "position", "application_state", six.alias("v"))
    every = every.select(*every.columns[:-1], "v.*").withColumn("group", M.match_group([F.col(f"v_{n}") for n in M.CONDITIONS]))
    return every.where(F.col("group") != "NOT_MATCHING")


def test_the_pair_list_has_every_pair_once_with_its_verdicts(spark, monkeypatch):
    products, profiles = notices(spark, 500).localCheckpoint(), applicants(spark, 120).localCheckpoint()
    want = sorted(map(tuple, all_pairs(products, profiles).collect()))
    assert {r[-1] for r in want} == set(M.GROUPS[:3])
    assert any(v.endswith("UNCERTAIN") for r in want for v in r[5:11])
    assert sorted(map(tuple, M.match_list(products, profiles, MQ.AS_OF, MQ.CITY).collect())) == want
    monkeypatch.setattr(M, "BLOCK", 50)       # several blocks, tasks by the number of pairs
    monkeypatch.setattr(M, "TASK_PAIRS", 9_000)
    assert sorted(map(tuple, M.match_list(products, profiles, MQ.AS_OF, MQ.CITY, 3).collect())) == want
    assert M.match_list(products.limit(0), profiles, MQ.AS_OF, MQ.CITY).count() == 0
    assert M.match_list(products, profiles.limit(0), MQ.AS_OF, MQ.CITY).count() == 0


def test_statuses_out_of_the_list_keep_their_words(spark):
    products, profiles = notices(spark, 60), applicants(spark, 30)
    products = products.withColumns({n: F.col(n).withField("status", F.when(F.col("position") % 2 == i % 2, "LOST").otherwise(F.col(n)["status"])) for i, n in enumerate(M.CONDITIONS)})
    want = sorted(map(tuple, all_pairs(products, profiles).collect()))
    assert want and sorted(map(tuple, M.match_list(products, profiles, MQ.AS_OF, MQ.CITY).collect())) == want


def test_the_last_opening_is_the_bound_that_adding_months_keeps(spark):
    days = spark.createDataFrame([(datetime.date(2015, 1, 1) + datetime.timedelta(i),) for i in range(0, 4000, 1)], "opened date")
    for day in ("2024-06-01", "2024-05-31", "2024-02-29", "2023-02-28", "2024-03-30"):
        d = F.lit(day).cast("date")
        rows = days.crossJoin(spark.createDataFrame([(m,) for m in (0, 1, 3, 12, 13, 36, 60, 84)], "m int"))
        odd = rows.where((F.add_months("opened", F.col("m")) <= d) != (F.col("opened") <= M.last_opening(d, F.col("m"))))
        assert odd.count() == 0


def test_a_pair_compares_numbers_and_builds_no_arrays(spark):
    plan = M.match_list(notices(spark, 20), applicants(spark, 20), MQ.AS_OF, MQ.CITY)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join Inner")]
    assert "Generate" not in above and "add_months" not in plan[:plan.index("RepartitionByExpression")]
