"""Releases, streams, matching and fits against second implementations."""

import random

import pytest
from pyspark.sql import functions as F

from placemetrics.operators import fit as FIT
from placemetrics.operators import franchise as FR
from placemetrics.operators import matching as M
from placemetrics.sources.release import PublishFailed, Store, Unavailable
from placemetrics.sources.tabular import HeaderMismatch, TableSchema, check_header
from placemetrics.streaming import throttle as TH

SF = "/root/testdata/sf0.001"


def test_release_life(spark, tmp_path):
    store = Store(spark, str(tmp_path), "panel")
    with pytest.raises(Unavailable):
        store.read_active()
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    assert store.publish(rows, "a") == "PUBLISHED"
    assert store.publish(rows, "a") == "ALREADY_ACTIVE"
    with pytest.raises(PublishFailed, match="bad"):
        store.publish(rows.limit(3), "b", verify=lambda d: ["bad"])
    assert store.status("b") == "FAILED" and store.read_active().count() == 10
    assert store.publish(rows.limit(4), "b") == "PUBLISHED"
    assert store.status("a") == "SUPERSEDED" and store.read_active().count() == 4
    assert store.publish(rows, "a", reactivate=True) == "REACTIVATED"
    assert store.read_active().count() == 10 and store.status("b") == "SUPERSEDED"
    with pytest.raises(PublishFailed):
        store.publish(rows.withColumn("v", F.raise_error(F.lit("broken source")).cast("bigint")), "c")
    assert store.status("c") == "FAILED" and store.status("a") == "ACTIVE"


def test_several_writers_end_with_one_active(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from placemetrics.sources import files

    rows = spark.range(20)
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda _: files.create_once(spark, f"{tmp_path}/once/file.json", "x"), range(8)))
        assert sorted(made) == [False] * 7 + [True]
        keys = ["a", "b", "c", "c"]
        outcomes = list(pool.map(lambda k: Store(spark, str(tmp_path), "panel").publish(rows.where(f"id < {5 + ord(k) % 7}"), k), keys))
    store = Store(spark, str(tmp_path), "panel")
    status = {r.release_key: r.status for r in store.releases().collect()}
    assert sorted(status) == ["a", "b", "c"] and list(status.values()).count("ACTIVE") == 1
    assert set(outcomes) <= {"PUBLISHED", "ALREADY_ACTIVE"}
    seqs = [r.seq for r in store.events().collect()]
    assert sorted(seqs) == list(range(len(seqs)))
    active = next(k for k, v in status.items() if v == "ACTIVE")
    assert store.read_active().count() == 5 + ord(active) % 7


def test_failed_reload_leaves_the_old_data(spark, tmp_path):
    store = Store(spark, str(tmp_path), "panel")
    store.publish(spark.range(10), "a")
    old = store.releases().where("release_key = 'a'").first()["parts"][0]["path"]
    store.publish(spark.range(3), "b")
    with pytest.raises(PublishFailed):
        store.publish(spark.range(7), "a", verify=lambda d: ["bad"])
    assert spark.read.parquet(old).count() == 10 and store.read_active().count() == 3
    assert store.publish(spark.range(7), "a") == "PUBLISHED"
    assert spark.read.parquet(old).count() == 10 and store.read_active().count() == 7


def test_increments_write_only_themselves(spark, tmp_path):
    from placemetrics.functions.hashing import multiset_fingerprint
    from placemetrics.sources.release import INCREMENT

    store = Store(spark, str(tmp_path), "panel")
    for k in range(6):
        assert store.append(spark.range(100 * k, 100 * k + 100), f"i{k}") == "APPENDED"
        assert store.append(spark.range(100 * k, 100 * k + 100), f"i{k}") == "ALREADY_HELD"
    release = store.releases().where("status = 'ACTIVE'").first()
    assert [spark.read.parquet(p["path"]).count() for p in release["parts"]] == [100] * 6
    written = sum(len(list(d.glob("*/*.parquet"))) > 0 for d in (tmp_path / "panel" / "data").iterdir())
    assert written == 6 and release["row_count"] == 600

    whole = store.read_active()
    assert release["release_key"] == "r-" + multiset_fingerprint(whole, sorted(whole.columns)).first()["fingerprint"]
    assert not store.compact(most=6) and store.compact(most=3)
    small = store.releases().where("status = 'ACTIVE'").first()
    assert small["release_key"] == release["release_key"] and len(small["parts"]) == 1
    assert sorted(r.id for r in store.read_active().collect()) == list(range(600))
    assert store.append(spark.range(1), "i3") == "ALREADY_HELD" and store.append(spark.range(600, 610), "late") == "APPENDED"
    assert store.read_active().where(F.col(INCREMENT) == "late").count() == 10
    # Two writers append at once: both increments are held.
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: Store(spark, str(tmp_path), "panel").append(spark.range(k, k + 5), f"t{k}"), (1000, 2000, 3000)))
    assert store.read_active().count() == 625


def test_header_set():
    s = TableSchema({"코드": "code", "이름": "name"})
    check_header(["이름", "코드"], s)
    for bad in (["코드"], ["코드", "이름", "x"], ["코드", "코드", "이름"]):
        with pytest.raises(HeaderMismatch):
            check_header(bad, s)


def fold(events, limit, window):
    """Plain sequential throttle."""
    state, out = {}, {}
    for user, event, t in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        start, count = state.get(user, (None, 0))
        if start is None or start + window <= t:
            start, count = t, 0
        count += 1
        state[user] = (start, count)
        out[event] = (start, count <= limit, None if count <= limit else max(1, -(-(start + window - t) // 1000)))
    return out


def test_throttle_batch_with_a_hot_user(spark):
    rnd = random.Random(3)
    events, t = [], 0
    for i in range(900):
        hot = i % 3 == 0
        t = rnd.randint(0, 40_000) if hot else rnd.randint(0, 400_000)
        events.append((0 if hot else rnd.randint(1, 20), i, t - t % (7 if hot else 1)))
    df = spark.createDataFrame(events, "user_id bigint, event_id bigint, t bigint").withColumn("ts", F.timestamp_millis("t"))
    for window in (1000, 7777):
        got = {r.event_id: (r.start_t, r.allowed, r.retry_after) for r in TH.throttle_audit(df, 3, window).collect()}
        assert got == fold(events, 3, window)


def test_throttle_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = {r.event_id: (r.start_t, r.allowed, r.retry_after) for r in TH.throttle_audit(events, 2, 6 * 3600 * 1000).collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parq*")
    q = (TH.throttle_stream(stream, 2, 6 * 3600 * 1000).writeStream.format("memory").queryName("throttled").outputMode("append")
         .option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.event_id: (r.start_t, r.allowed, r.retry_after) for r in spark.table("throttled").collect()}
    assert got == batch


def test_streams_landed_in_slices_equal_the_batch_jobs(spark, tmp_path):
    from placemetrics.plans import source_queries as SQ

    for replay, batch in (("throttle_replay", "throttle_audit"), ("freshness_replay", "source_freshness")):
        got, want = ([tuple(r) for r in SQ.QUERIES[name](spark, SF).collect()] for name in (replay, batch))
        assert len(got) == len(want) > 0 and set(got) == set(want)


def test_a_batch_of_successes_that_runs_again_changes_nothing(spark, tmp_path):
    from placemetrics.streaming import jobs as J

    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), (None, "2024-01-05 00:00:00"), ("a", None)]
    later = [("a", "2023-12-01 00:00:00"), ("b", "2024-01-04 00:00:00")]
    schema = "source string, ts timestamp"
    for landing in (rows, later, later):
        spark.createDataFrame(landing, "source string, ts string").selectExpr("source", "CAST(ts AS timestamp) AS ts").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        J.stream_last_success(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r.source: str(r.last_succeeded_at) for r in J.newest_batch(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": "2024-01-01 00:00:00", "b": "2024-01-04 00:00:00", None: "2024-01-05 00:00:00"}


def test_match_list_is_the_whole_product_without_mismatches(spark):
    from placemetrics.plans import matching_queries as MQ
    from placemetrics.plans.proxies import Tables

    t = Tables(spark, SF)
    products, profiles = MQ.f_notice(t), MQ.f_profile(t)
    got = {(r.profile_id, r.product_key, r.group) for r in M.match_list(products, profiles, MQ.AS_OF, MQ.CITY).collect()}
    v = M.six_verdicts({n: F.col(n) for n in M.CONDITIONS}, F.col("profile"), F.lit(MQ.AS_OF).cast("date"))
    v["region"] = M.apply_title_mark(v["region"], F.col("region.status"), F.col("mark"))
    every = products.where("closed_by IS NULL").crossJoin(profiles).select("profile_id", "product_key", *[v[n].alias(f"v_{n}") for n in M.CONDITIONS])
    every = every.withColumn("group", M.match_group([F.col(f"v_{n}") for n in M.CONDITIONS])).where(F.col("group") != "NOT_MATCHING")
    assert got == {(r.profile_id, r.product_key, r.group) for r in every.collect()} and got


def test_counts_and_pages_on_classes_are_those_of_all_pairs(spark):
    from collections import Counter

    from placemetrics.plans import matching_queries as MQ
    from placemetrics.plans.proxies import Tables

    t = Tables(spark, SF)
    products, profiles = MQ.f_notice(t), MQ.f_profile(t)
    # A third of the applicants are one and the same person, and one notice stands many times.
    same = profiles.where("profile_id = 2")
    profiles = profiles.unionByName(same.crossJoin(spark.range(5)).select((F.col("id") + 1000).alias("profile_id"), "profile"))
    copies = products.where("closed_by IS NULL").orderBy("position").limit(1).crossJoin(spark.range(30))
    products = products.unionByName(copies.withColumns({"product_key": F.concat(F.lit("c-"), "id"), "position": F.col("id") + 5000}).drop("id"))
    listed = M.match_list(products, profiles, MQ.AS_OF, MQ.CITY).select("profile_id", "product_key", "tab", "position", "application_state", "group").collect()

    per = Counter((r.profile_id, r.tab, r.group) for r in listed)
    counts = M.match_counts(products, profiles, MQ.AS_OF).collect()
    assert len(counts) == 2 * profiles.count()
    for r in counts:
        assert (r.matching, r.not_mentioned_only, r.needs_check) == tuple(per[r.profile_id, r.tab, g] for g in M.GROUPS[:3])
    per = Counter((r.product_key, r.group) for r in listed)
    shut = {r.product_key for r in products.where("closed_by IS NOT NULL").collect()}
    for r in M.product_counts(products, profiles, MQ.AS_OF).collect():
        want = tuple(per[r.product_key, g] for g in M.GROUPS[:3])
        assert (r.matching, r.not_mentioned_only, r.needs_check) == want
        assert (r.not_matching, r.closed) == ((0, profiles.count()) if r.product_key in shut else (profiles.count() - sum(want), 0))
    pages = {}
    for r in listed:
        key = 2 * M.GROUPS.index(r.group) + (r.application_state != "OPEN_CONFIRMED")
        pages.setdefault((r.profile_id, r.tab), []).append((key, r.position, r.product_key))
    got = {}
    for r in M.first_page(products, profiles, MQ.AS_OF, 7).collect():
        got.setdefault((r.profile_id, r.tab), []).append((r.order_key, r.position, r.product_key, r["rank"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(*x, i + 1) for i, x in enumerate(sorted(v)[:7])] for k, v in pages.items()}
    assert M.match_counts(products.limit(0), profiles.limit(0), MQ.AS_OF).count() == 0


def test_month_end_and_group_rules(spark):
    day = F.lit("2024-06-30").cast("date")
    r = F.struct(F.lit("READ").alias("status"), F.lit(None).cast("double").alias("min"), F.lit(1.0).alias("max"), F.lit(False).alias("excl"))

    def opened(month):
        p = F.struct(F.lit("BUSINESS").alias("status"), F.lit(month).alias("opened"))
        return M.business_age_verdict(r, p, day)

    row = spark.range(1).select(opened("2023-07").alias("a"), opened("2023-06").alias("b"), opened("2023-05").alias("c"), opened("2024-07").alias("d")).first()
    assert list(row) == ["MATCH", "CHECK:UNCERTAIN", "MISMATCH", "CHECK:UNCERTAIN"]
    groups = spark.createDataFrame([(["MATCH"] * 6,), (["MATCH"] * 4 + ["CHECK:NOT_MENTIONED"] * 2,), (["CHECK:NOT_MENTIONED"] * 5 + ["CHECK:UNCERTAIN"],),
                                    (["MISMATCH"] + ["CHECK:NOT_READ"] * 5,)], "v array<string>")
    got = [x[0] for x in groups.select(M.match_group([F.col("v")[i] for i in range(6)])).collect()]
    assert got == ["MATCHING", "NOT_MENTIONED_ONLY", "NEEDS_CHECK", "NOT_MATCHING"]


def test_search_many_equals_contains(spark):
    rows = spark.createDataFrame([(1, "Alpha Coffee", "Corp A"), (2, "beta", "ALPHABET"), (3, "x", "y")], "id int, brand_name string, corp_name string")
    req = spark.createDataFrame([("alpha",), ("A",), ("zz",), ("PHAB",), ("x",)], "query string")
    got = {(r.query, r.id) for r in FR.search_many(rows, req, "id").collect()}
    assert got == {("alpha", 1), ("alpha", 2), ("A", 1), ("A", 2), ("PHAB", 2), ("x", 3)}


def test_newton_equals_glm(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        rows.append(("i", a, b, int(rnd.random() < 1 / (1 + 2.718281828 ** -(0.3 + 0.8 * a - 0.5 * b)))))
    df = spark.createDataFrame(rows, "industry_code string, a double, b double, label int")
    fit = {r.name: r for r in FIT.fit_logistic(df, {"m": ("a", "b")}).collect()}
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label", maxIter=50, tol=1e-10).fit(
        VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    assert fit["intercept"].beta == pytest.approx(glm.intercept, abs=1e-6)
    assert [fit["a"].beta, fit["b"].beta] == pytest.approx(list(glm.coefficients), abs=1e-6)
    assert [fit["a"].std_error, fit["b"].std_error] == pytest.approx(glm.summary.coefficientStandardErrors[:2], abs=1e-6)
    assert fit["a"].converged and fit["a"].iterations < 10
