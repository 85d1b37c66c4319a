"""Registered queries of sources, sinks, releases and streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.plans import proxies as X
from placemetrics.plans.proxies import Tables
from placemetrics.plans.sqlbase import cte, sql
from placemetrics.session import shared_dir
from placemetrics.sources import paged as PG
from placemetrics.sources import release as R
from placemetrics.sources import tabular as TB
from placemetrics.streaming import jobs as J
from placemetrics.streaming import throttle as TH

QUERIES, ORACLE = {}, {}


def query(name: str, needs=None, body: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(needs, body) if needs else body
        return fn
    return add


def _new_dir(t: Tables, name: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- landed pages

def f_pages(t: Tables) -> DataFrame:
    """Orders as landed pages of at most 100 rows; some requests are broken."""
    k = F.col("o_orderkey")
    page, part = F.floor(k / 100), F.floor(k / 100) % 12
    o = t.orders.select(part.alias("part"), page.alias("page"), F.struct(k.alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio")).alias("r"))
    per = o.groupBy("part", "page").agg(F.collect_list("r").alias("rows"), F.count(F.lit(1)).alias("n"))     # a page holds its key range only
    totals = per.groupBy("part").agg(F.sum("n").alias("total"), F.max("page").alias("last"))
    j = per.join(totals, "part")
    last = F.col("page") == F.col("last")
    total = F.when((F.col("part") == 7) & last, F.col("total") + 1).otherwise(F.col("total"))
    code = F.when((F.col("part") == 5) & last, "ERROR-300").otherwise(PG.OK_CODE)
    rows = F.when((F.col("part") == 9) & last, F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows"))
    body = F.to_json(F.struct(total.alias("total"), code.alias("code"), rows.alias("row")))
    return j.select("part", "page", F.when((F.col("part") == 3) & last, F.lit("<html>")).otherwise(body).alias("body"))


@query("paged_json_complete", None, """SELECT part, CASE part WHEN 5 THEN 'ERROR-300' WHEN 3 THEN 'NOT_JSON' END AS error_code, CASE WHEN part = 7 THEN n + 1 WHEN part = 3 AND pages = 1 THEN NULL ELSE n END AS total,
 CASE WHEN part = 5 THEN n WHEN part = 3 THEN n - lastn WHEN part = 9 THEN n - 1 ELSE n END AS row_count,
 CASE part WHEN 3 THEN 'ERROR_CODE' WHEN 5 THEN 'ERROR_CODE' WHEN 7 THEN CASE WHEN pages > 1 THEN 'TOTAL_CHANGED' ELSE 'INCOMPLETE' END WHEN 9 THEN 'INCOMPLETE' ELSE 'OK' END AS outcome FROM (
 SELECT part, count(*) AS n, count(DISTINCT page) AS pages, count(*) FILTER (page = last) AS lastn FROM (SELECT *, max(page) OVER (PARTITION BY part) AS last FROM (
  SELECT o_orderkey // 100 AS page, o_orderkey // 100 % 12 AS part FROM orders)) GROUP BY 1)""".replace("CASE WHEN part = 5 THEN n WHEN part = 3", "CASE WHEN part IN (3, 5)"))
def paged_json_complete(t):
    parsed = PG.parse_pages(f_pages(t), "id bigint, cust bigint, prio string")
    return PG.page_checks(parsed, ["part"])


@query("paged_json_rows", None, """SELECT part, prio, count(*) AS row_count, CAST(sum(cust) AS BIGINT) AS custs FROM (SELECT o_orderkey // 100 % 12 AS part, o_orderpriority AS prio, o_custkey AS cust FROM orders)
WHERE part NOT IN (3, 5, 7, 9) GROUP BY 1, 2""")
def paged_json_rows(t):
    rows, _ = PG.read_paged_json(f_pages(t), "id bigint, cust bigint, prio string", ["part"])
    return rows.groupBy("part", "prio").agg(F.count(F.lit(1)).alias("row_count"), F.sum("cust").alias("custs"))


@query("positional_rows", None, """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer""")
def positional_rows(t):
    k = F.col("c_custkey")
    id_, seg = k.cast("string"), F.col("c_mktsegment")
    columns = F.when(k % 2 == 0, F.array(F.lit("id"), F.lit("name"), F.lit("segment"))).otherwise(F.array(F.lit("segment"), F.lit("id"), F.lit("name")))
    short = F.array(id_, F.col("c_name"))
    item = F.when(k % 2 == 0, F.when(k % 7 == 0, short).otherwise(F.array(id_, F.col("c_name"), seg))).otherwise(
        F.array(F.when(k % 7 != 0, seg), id_, F.col("c_name")))
    d = t.customer.select(columns.alias("columns"), F.array(item).alias("items"))
    return PG.zip_columns(d, "columns", "items", ["id", "name", "segment"])


@query("field_drift", None, """SELECT missing, unexpected, count(*) AS row_count, min(k) AS first_row FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'brand' WHEN p_partkey % 13 = 0 THEN 'name,size' ELSE '' END AS missing,
 CASE WHEN p_partkey % 17 = 0 THEN 'colour' ELSE '' END AS unexpected FROM part) WHERE missing <> '' OR unexpected <> '' GROUP BY 1, 2""")
def field_drift(t):
    k = F.col("p_partkey")
    b13 = (k % 13 == 0) & (k % 11 != 0)
    body = F.to_json(F.struct(k.alias("id"), F.when(~b13, F.col("p_name")).alias("name"), F.when(k % 11 != 0, F.col("p_brand")).alias("brand"),
                              F.when(~b13, F.col("p_size")).alias("size"), F.when(k % 17 == 0, F.lit("red")).alias("colour")))
    return PG.field_drift(t.part.select(k.alias("k"), body.alias("body")), "body", ["id", "name", "brand", "size"], "k")


_FP = " || '/' || ".join(f"CAST(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT::HUGEINT) AS VARCHAR)" for i in range(8))


def _cell(c: str) -> str:
    return f"length(CAST({c} AS VARCHAR)) || ':' || {c}"


@query("source_manifest", None, f"""
WITH x AS (SELECT l_returnflag AS role, year(l_shipdate) AS part, l_orderkey AS a, l_linenumber AS b FROM lineitem),
p AS (SELECT role, part, CAST(sum(c) AS BIGINT) AS n, sha256({_FP} || '/' || CAST(sum(c) AS VARCHAR)) AS fp FROM (SELECT role, part, c, sha256(r || 'x' || c) AS h FROM (
  SELECT role, part, r, count(*) AS c FROM (SELECT role, part, sha256({_cell('a')} || '|' || {_cell('b')}) AS r FROM x) GROUP BY 1, 2, 3)) GROUP BY 1, 2)
SELECT role, count(*) AS parts, sha256({_FP} || '/' || count(*)) AS fingerprint, CAST(sum(n) AS BIGINT) AS row_count FROM (SELECT role, n, sha256(sha256({_cell('part')} || '|' || {_cell('fp')}) || 'x1') AS h FROM p) GROUP BY 1""")
def source_manifest(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("role"), F.year("l_shipdate").alias("part"), "l_orderkey", "l_linenumber")
    return PG.source_manifest(rows, "role", "part", ["l_orderkey", "l_linenumber"])[1]


@query("src_header_map", None, """SELECT segment, count(*) AS row_count FROM (SELECT CASE WHEN c_custkey % 50 = 3 THEN 'ROW_WIDTH' ELSE c_mktsegment END AS segment FROM customer) GROUP BY 1""")
def src_header_map(t):
    """Customers written as delimited text under other column names, in two orders of columns, every 50th row too wide, read back by name."""
    path = _new_dir(t, "csv")
    k = F.col("c_custkey")
    line = F.concat_ws(",", k.cast("string"), "c_name", "c_mktsegment", F.when(k % 50 == 3, F.lit("extra")))
    other = F.concat_ws(",", "c_mktsegment", k.cast("string"), "c_name", F.when(k % 50 == 3, F.lit("extra")))
    t.customer.where(k % 2 == 0).select(line.alias("고객_코드,이름,업종")).write.option("header", "true").option("sep", "|").csv(path)
    t.customer.where(k % 2 == 1).select(other.alias("업종,고객_코드,이름")).write.mode("append").option("header", "true").option("sep", "|").csv(path)
    rows, bad = TB.read_versioned(t.spark, path, TB.TableSchema({"이름": "name", "고객_코드": "custkey", "업종": "segment"}))
    good = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("row_count"))
    return good.unionByName(bad.groupBy(F.col("code").alias("segment")).agg(F.count(F.lit(1)).alias("row_count")))


# ---------------------------------------------------------------- releases

@query("release_publish", ["f_panel"], """SELECT release_key, status, CAST(row_count AS BIGINT) AS row_count, reason, (SELECT count(*) FROM f_panel) AS active_rows FROM (
 SELECT 'k1' AS release_key, 'SUPERSEDED' AS status, count(*) FILTER (quarter_idx < 8000) AS row_count, CAST(NULL AS VARCHAR) AS reason FROM f_panel
 UNION ALL SELECT 'k2', 'ACTIVE', count(*), NULL FROM f_panel UNION ALL SELECT 'k3', 'FAILED', NULL, 'no sales at all')""")
def release_publish(t):
    """Two panel releases, a repeat of the second and one that fails its check; the table of releases after it."""
    store = R.Store(t.spark, _new_dir(t, "store"), "panel")
    panel = X.f_panel(t).persist()
    try:
        store.publish(panel.where("quarter_idx < 8000"), "k1", sort_by=["industry_code", "area_code", "quarter_idx"])
        store.publish(panel, "k2", sort_by=["industry_code", "area_code", "quarter_idx"])
        store.publish(panel, "k2")
        try:
            store.publish(panel.where("sales_amount IS NULL"), "k3", verify=lambda d: ["no sales at all"] if d.where("sales_amount IS NOT NULL").isEmpty() else [])
        except R.PublishFailed:
            pass
    finally:
        panel.unpersist()
    active = store.read_active().agg(F.count(F.lit(1)).alias("active_rows"))
    return store.releases().select("release_key", "status", "row_count", "reason").crossJoin(active)      # one row


cte("f_rel", (), """SELECT 'r' || o_orderkey AS release_key, o_custkey, o_custkey % 60 AS line, (['ACTIVE', 'SUPERSEDED', 'FAILED', 'PENDING', 'SUPERSEDED'])[CASE WHEN o_custkey % 60 % 7 = 0 THEN 1 ELSE 0 END + o_orderkey % 4 + 1] AS status,
 o_orderdate AS activated_at FROM orders""")


def f_releases(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    states = F.array(*[F.lit(s) for s in ("ACTIVE", "SUPERSEDED", "FAILED", "PENDING", "SUPERSEDED")])
    i = F.when(c % 60 % 7 == 0, 1).otherwise(0) + k % 4
    return t.orders.select(F.concat(F.lit("r"), k.cast("string")).alias("release_key"), c.alias("o_custkey"), (c % 60).alias("line"),
                           F.get(states, i.cast("int")).alias("status"), F.col("o_orderdate").alias("activated_at"))


@query("release_outcome", ["f_rel"], """SELECT outcome, count(*) AS row_count FROM (SELECT CASE WHEN r.status IS NULL THEN 'NEW' WHEN r.status = 'ACTIVE' THEN 'ALREADY_ACTIVE'
 WHEN r.status = 'SUPERSEDED' AND l_linenumber % 2 = 0 THEN 'REACTIVATED' ELSE 'REPLACED' END AS outcome FROM lineitem LEFT JOIN f_rel r ON release_key = 'r' || (l_orderkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END)) GROUP BY 1""")
def release_outcome(t):
    req = t.lineitem.select(F.concat(F.lit("r"), (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)).cast("string")).alias("release_key"), "l_linenumber")
    return R.publish_outcome(req, f_releases(t), F.col("l_linenumber") % 2 == 0).groupBy("outcome").agg(F.count(F.lit(1)).alias("row_count"))


@query("active_release", ["f_rel"], """SELECT line, coalesce(arg_max(release_key, (activated_at, release_key)) FILTER (status = 'ACTIVE'), 'UNAVAILABLE') AS release_key, count(*) FILTER (status = 'ACTIVE') AS active_count FROM f_rel GROUP BY 1""")
def active_release(t):
    return R.active_releases(f_releases(t), ["line"])


@query("release_verify", ["f_panel"], """SELECT industry_code, count(*) AS row_count, count(sales_amount) AS with_measure, count(*) - count(sales_amount) AS without_measure FROM f_panel GROUP BY 1""")
def release_verify(t):
    return R.verify_written(X.f_panel(t), "sales_amount", ["industry_code"])


@query("score_snapshot", ["f_stores", "f_area"], """
, s AS (SELECT 'r' || (quarter_idx % 4) AS release_key, industry_code, area_code, similar_store_count * 3 % 101 AS score, sales FROM (SELECT t.*, similar_store_count * 1000 AS sales FROM f_stores t WHERE quarter_idx BETWEEN 7996 AND 7999) WHERE similar_store_count >= 3),
q AS (SELECT c_custkey AS plan_id, 'r' || c_custkey % 5 AS release_key, 'CS10000' || (c_custkey % 5 + 1) AS industry_code, CAST(3000000 + c_nationkey + CASE WHEN c_custkey % 9 = 0 THEN 500 ELSE 0 END AS VARCHAR) AS area_code FROM customer)
SELECT plan_id, s.score IS NOT NULL AND a.area_name IS NOT NULL AND q.release_key IN ('r0', 'r1') AS snapshot, CASE WHEN s.score IS NOT NULL AND a.area_name IS NOT NULL AND q.release_key IN ('r0', 'r1') THEN s.score END AS score
FROM q LEFT JOIN s USING (release_key, industry_code, area_code) LEFT JOIN f_area a USING (area_code)""")
def score_snapshot(t):
    k = F.col("c_custkey")
    refs = t.customer.select(k.alias("plan_id"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("release_key"), F.concat(F.lit("CS10000"), (k % 5 + 1).cast("string")).alias("industry_code"),
                             (F.col("c_nationkey") + 3000000 + F.when(k % 9 == 0, 500).otherwise(0)).cast("string").alias("area_code"))
    cells = X.f_stores(t).where("quarter_idx BETWEEN 7996 AND 7999")
    n = F.col("similar_store_count")
    scores = cells.select(F.concat(F.lit("r"), (F.col("quarter_idx") % 4).cast("string")).alias("release_key"), "industry_code", "area_code",
                          F.when(n >= 3, "SCORED").otherwise("INSUFFICIENT_STORES").alias("status"), (n * 3 % 101).alias("score"), (n * 1000).alias("monthly_revenue"))
    state = F.when(F.col("release_key") == "r0", "ACTIVE").when(F.col("release_key") == "r1", "SUPERSEDED").otherwise("FAILED")
    releases = scores.select("release_key").distinct().withColumn("status", state)
    return R.snapshot_scores(refs, releases, scores, X.f_area(t)).select("plan_id", "snapshot", "score")


# ---------------------------------------------------------------- streams

WINDOW_MS, LIMIT = 6 * 3600 * 1000, 2


_AUDIT = f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events),
a AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT user_id, n FROM (SELECT a.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = a.user_id AND e.t >= a.t + {WINDOW_MS}) AS n FROM a) WHERE n IS NOT NULL),
p AS (SELECT e.user_id, event_id, e.t, max(a.t) AS start_t FROM e JOIN a ON a.user_id = e.user_id AND a.t <= e.t GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, start_t ORDER BY t, event_id) AS rn FROM p)
SELECT user_id, event_id, start_t, rn <= {LIMIT} AS allowed, CASE WHEN rn > {LIMIT} THEN CAST(greatest(1, ceil((start_t + {WINDOW_MS} - t) / 1000.0)) AS BIGINT) END AS retry_after FROM r"""


@query("throttle_audit", None, _AUDIT)
def throttle_audit(t):
    return TH.throttle_audit(t.events, LIMIT, WINDOW_MS)


def _landings(t: Tables, base: str, columns: list[str], slices: int = 3) -> Iterator[DataFrame]:
    """The events as a stream that lands in slices of time; each step has landed one more slice. Events without a time never land."""
    events = t.events.select(*columns)
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:      # no event: one empty landing
        lo = hi = datetime(1970, 1, 1)
    cuts = [F.lit(str(lo + (hi - lo) * i / slices)).cast(events.schema["ts"].dataType) for i in range(1, slices)]
    part = sum((F.col("ts") >= c).cast("int") for c in cuts)
    for k in range(slices):
        events.where(part == k).write.mode("append").parquet(f"{base}/landing")
        yield t.spark.readStream.schema(events.schema).parquet(f"{base}/landing")


@query("throttle_replay", None, _AUDIT)
def throttle_replay(t):
    """The audit as a stream: the open window of a user is carried from landing to landing."""
    base = _new_dir(t, "throttle")
    for landed in _landings(t, base, ["user_id", "event_id", "ts"]):
        out = TH.throttle_stream(landed, LIMIT, WINDOW_MS).writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
        out.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(TH.OUT).parquet(f"{base}/out")


@query("stream_increment", ["f_sales"], "SELECT count(*) AS active_rows, CAST(sum(sales_amount) AS BIGINT) AS active_amount, CAST(3 AS BIGINT) AS releases FROM f_sales WHERE sales_amount >= 0")
def stream_increment(t):
    """Three landings of panel rows, the second of them twice; the rows of the ACTIVE release, which are all that landed."""
    base = _new_dir(t, "stream")
    store = R.Store(t.spark, f"{base}/store", "panel")
    panel = X.f_sales_keyed(t).persist()
    schema = panel.schema
    try:
        for cond in ("quarter_idx < 7990", "quarter_idx >= 7990 AND quarter_idx < 7998", "quarter_idx >= 7990 AND quarter_idx < 7998", "quarter_idx >= 7998"):
            panel.where(cond).write.mode("append").parquet(f"{base}/landing")
            landing = t.spark.readStream.schema(schema).parquet(f"{base}/landing")
            J.stream_panel(landing, store, f"{base}/checkpoint", lambda d: d.where("sales_amount >= 0")).awaitTermination()
    finally:
        panel.unpersist()
    active = store.read_active().agg(F.count(F.lit(1)).alias("active_rows"), F.sum("sales_amount").alias("active_amount"))
    return active.crossJoin(store.releases().agg(F.count(F.lit(1)).alias("releases")))


_FRESH = """SELECT source, CAST(max(ts) AS DATE) AS last_succeeded_on, CAST(max(ts) AS DATE) + 3 >= DATE '2024-01-28' + CAST(length(source) AS INTEGER) AS fresh FROM (SELECT event_type AS source, ts FROM events) GROUP BY 1"""


@query("source_freshness", None, _FRESH)
def source_freshness(t):
    return _fresh(J.last_success(t.events.select(F.col("event_type").alias("source"), "ts")))


def _fresh(last: DataFrame) -> DataFrame:
    as_of = F.date_add(F.lit("2024-01-28").cast("date"), F.length("source"))
    return J.source_freshness(last, as_of).select("source", "last_succeeded_on", "fresh")


@query("freshness_replay", None, _FRESH)
def freshness_replay(t):
    """The monitor as a stream: the newest success per source is carried from landing to landing."""
    base = _new_dir(t, "freshness")
    for landed in _landings(t, base, ["event_type", "ts"]):
        J.stream_last_success(landed.withColumnRenamed("event_type", "source"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return _fresh(J.newest_batch(t.spark, f"{base}/out"))
