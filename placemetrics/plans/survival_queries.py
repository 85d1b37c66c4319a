"""Registered queries of the survival score: features, labels, scoring, evaluation, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.ranks import exact_median
from placemetrics.operators import fit as FIT
from placemetrics.operators import panel as P
from placemetrics.operators import survival as S
from placemetrics.plans import proxies as X
from placemetrics.plans.proxies import MIN_STORES, Tables
from placemetrics.plans.sqlbase import cte, sql
from placemetrics.session import cut

QUERIES, ORACLE = {}, {}


def query(name: str, needs=None, body: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(needs, body) if needs else body
        return fn
    return add


# Fixed coefficients for the checkable scoring queries: intercept, then (beta, mean, std) per feature.
INTERCEPT = -0.15
COEFFICIENTS = {
    "sales_growth": (-0.35, 0.02, 0.9), "sales_per_store": (0.25, 17.2, 0.6), "store_count_log": (-0.2, 1.6, 0.35),
    "past_closure_rate": (0.6, 0.12, 0.15), "past_open_rate": (-0.3, 0.2, 0.3), "franchise_share": (0.4, 0.2, 0.17)}
NO_FRANCHISE_STD = 1.0
KEYS = "area_type, area_code, industry_code, quarter_idx"


def fixed_model(t: Tables) -> DataFrame:
    """The fixed coefficients for every industry, as the table ``score_rows`` reads."""
    cols = [F.lit(INTERCEPT).alias("intercept")]
    for f, (b, m, s) in COEFFICIENTS.items():
        cols += [F.lit(b).alias(f"beta_{f}"), F.lit(m).alias(f"mean_{f}"), F.lit(s).alias(f"std_{f}")]
    return X.f_industry(t).select("industry_code", *cols)


def features(t: Tables) -> DataFrame:
    return S.build_features(X.f_panel(t), min_stores=MIN_STORES)


def usable(t: Tables) -> DataFrame:
    return features(t).where("reason IS NULL")


def samples(t: Tables) -> DataFrame:
    return S.label_by_median(S.training_rows(features(t)))


def split(t: Tables) -> DataFrame:
    panel = cut(X.f_panel(t))       # read for the features and for the span of its quarters
    found = S.label_by_median(S.training_rows(S.build_features(panel, min_stores=MIN_STORES)))
    return S.split_by_time(found, panel)


def scored(t: Tables) -> DataFrame:
    return S.score_rows(usable(t), fixed_model(t))


def latest(df: DataFrame) -> DataFrame:
    """Rows of the newest quarter that has usable rows; the rows are read once for it and once by the summary."""
    df = cut(df)
    usable_rows = df.where("reason IS NULL") if "reason" in df.columns else df
    newest = usable_rows.agg(F.max("quarter_idx").alias("quarter_idx"))
    return df.join(F.broadcast(newest), "quarter_idx")     # one row


_ONE = "p.area_code = q.area_code AND p.industry_code = q.industry_code"
cte("f_win", ("f_panel",), f"""SELECT p.*, q.sales_amount AS prior_sales,
  CASE WHEN q.similar_store_count > 0 THEN q.similar_store_count END AS prior_stores, w.window_sales, w.window_stores,
  w.window_closed, w.window_opened, CASE WHEN p.similar_store_count > 0 THEN fu.closed / p.similar_store_count END AS future_closure_rate
  FROM f_panel p LEFT JOIN f_panel q ON {_ONE} AND q.quarter_idx = p.quarter_idx - 4
  LEFT JOIN (SELECT p.area_code, p.industry_code, p.quarter_idx,
      CASE WHEN count(q.sales_amount + q.similar_store_count) = 4 THEN CAST(sum(q.sales_amount) AS BIGINT) END AS window_sales,
      CASE WHEN count(q.sales_amount + q.similar_store_count) = 4 THEN CAST(sum(q.similar_store_count) AS BIGINT) END AS window_stores,
      CASE WHEN count(q.closed_store_count) = 4 THEN CAST(sum(q.closed_store_count) AS BIGINT) END AS window_closed,
      CASE WHEN count(q.opened_store_count) = 4 THEN CAST(sum(q.opened_store_count) AS BIGINT) END AS window_opened
    FROM f_panel p JOIN f_panel q ON {_ONE} AND q.quarter_idx BETWEEN p.quarter_idx - 3 AND p.quarter_idx GROUP BY 1, 2, 3) w
   ON w.area_code = p.area_code AND w.industry_code = p.industry_code AND w.quarter_idx = p.quarter_idx
  LEFT JOIN (SELECT p.area_code, p.industry_code, p.quarter_idx,
      CASE WHEN count(q.closed_store_count) = 4 THEN sum(q.closed_store_count) END AS closed
    FROM f_panel p JOIN f_panel q ON {_ONE} AND q.quarter_idx BETWEEN p.quarter_idx + 1 AND p.quarter_idx + 4 GROUP BY 1, 2, 3) fu
   ON fu.area_code = p.area_code AND fu.industry_code = p.industry_code AND fu.quarter_idx = p.quarter_idx""")
cte("f_feat", ("f_win",), f"""SELECT *,
  CASE WHEN similar_store_count IS NULL THEN 'NO_DATA' WHEN similar_store_count < {MIN_STORES} THEN 'FEW_STORES'
   WHEN coalesce(sales_amount, 0) <= 0 THEN 'NO_SALES' WHEN coalesce(prior_sales, 0) <= 0 THEN 'NO_PRIOR_SALES'
   WHEN window_sales IS NULL THEN 'INCOMPLETE_WINDOW'
   WHEN franchise_store_count IS NULL OR window_closed IS NULL OR window_opened IS NULL OR prior_stores IS NULL THEN 'FEATURE_UNAVAILABLE' END AS reason
  FROM f_win""")
cte("f_ok", ("f_feat",), """SELECT *, ln(sales_amount::DOUBLE) - ln(prior_sales::DOUBLE) AS sales_growth,
  ln(window_sales::DOUBLE / (window_stores::DOUBLE / 4)) AS sales_per_store, ln(similar_store_count::DOUBLE) AS store_count_log,
  window_closed::DOUBLE / prior_stores AS past_closure_rate, window_opened::DOUBLE / prior_stores AS past_open_rate,
  franchise_store_count::DOUBLE / similar_store_count AS franchise_share FROM f_feat WHERE reason IS NULL""")
cte("f_sample", ("f_ok",), """SELECT *, CASE WHEN future_closure_rate > median_rate THEN 1 ELSE 0 END AS label FROM (
  SELECT *, median(future_closure_rate) OVER (PARTITION BY industry_code, quarter_idx) AS median_rate FROM f_ok
  WHERE future_closure_rate IS NOT NULL)""")
cte("f_split", ("f_sample", "f_panel"), """SELECT s.*, CASE WHEN quarter_idx > hi - 8 THEN 'test' ELSE 'train' END AS part
  FROM f_sample s, (SELECT min(quarter_idx) AS lo, max(quarter_idx) AS hi FROM f_panel) WHERE quarter_idx BETWEEN lo + 4 AND hi - 4""")
_Z = {f: f"greatest(-3.0, least(3.0, ({f} - {m}) / {s}))" for f, (b, m, s) in COEFFICIENTS.items()}
_LOGIT = f"{INTERCEPT} + " + " + ".join(f"({b}) * {_Z[f]}" for f, (b, m, s) in COEFFICIENTS.items())
_GRADE = "CASE " + " ".join(f"WHEN score >= {low} THEN '{g}'" for g, low in S.GRADE_BOUNDS) + " END"
_SCORED = f"""SELECT *, {_GRADE} AS grade FROM (SELECT *, CAST(floor((1 - probability) * 100 + 0.5) AS INTEGER) AS score FROM (
  SELECT *, 1 / (1 + exp(-({_LOGIT}))) AS probability FROM %s))"""
cte("f_scored", ("f_ok",), _SCORED % "f_ok")
cte("f_scored_test", ("f_split",), _SCORED % "(SELECT * FROM f_split WHERE part = 'test')")
_HALF = "CAST(CASE WHEN ({a}) < 0 THEN -((2 * -({a})::HUGEINT + ({b})) // (2 * ({b}))) ELSE (2 * ({a})::HUGEINT + ({b})) // (2 * ({b})) END AS BIGINT)"


def half(a: str, b: str) -> str:
    return _HALF.format(a=a, b=f"({b})::HUGEINT")


_SHOW = {
    "sales_growth": half("(sales_amount::HUGEINT - prior_sales) * 1000000", "prior_sales"),
    "sales_per_store": half("window_sales", "window_stores * 3"),
    "store_count_log": "CAST(similar_store_count AS BIGINT)",
    "past_closure_rate": half("window_closed::HUGEINT * 1000000", "prior_stores"),
    "past_open_rate": half("window_opened::HUGEINT * 1000000", "prior_stores"),
    "franchise_share": half("franchise_store_count::HUGEINT * 1000000", "similar_store_count")}
cte("f_shown", ("f_scored",), "SELECT *, " + ", ".join(f"{e} AS show_{f}" for f, e in _SHOW.items()) + " FROM f_scored")


# ---------------------------------------------------------------- features, labels

@query("survival_features", ["f_ok"], f"SELECT {KEYS}, " + ", ".join(f"round({f}, 9) AS {f}" for f in S.FEATURES) + " FROM f_ok")
def survival_features(t):
    return usable(t).select(*P.KEY, *[F.round(f, 9).alias(f) for f in S.FEATURES])


@query("exclusions", ["f_feat", "f_series"], """
SELECT g.industry_code, g.quarter_idx, """ + ", ".join(
    f"count(CASE WHEN r = '{x}' THEN 1 END) AS {x.lower()}" for x in S.TRAINING_REASONS) + """,
 count(CASE WHEN r = 'OK' THEN 1 END) AS ok FROM (
 SELECT s.industry_code, q AS quarter_idx, CASE WHEN f.area_code IS NULL THEN 'NO_DATA' WHEN reason IS NOT NULL THEN reason
   WHEN future_closure_rate IS NULL THEN 'NO_FUTURE_DATA' ELSE 'OK' END AS r
 FROM f_series s CROSS JOIN (SELECT DISTINCT CAST(unnest(generate_series(min(quarter_idx), max(quarter_idx))) AS INTEGER) AS q FROM f_feat) x
 LEFT JOIN f_feat f ON f.area_code = s.area_code AND f.industry_code = s.industry_code AND f.quarter_idx = x.q) g GROUP BY 1, 2""")
def exclusions(t):
    panel = cut(X.f_panel(t))
    feats = S.build_features(panel, min_stores=MIN_STORES)
    return S.exclusion_counts(feats, S.series_grid(panel, X.f_series(t).select(*P.SERIES)))


@query("closure_median", ["f_ok"], """
SELECT industry_code, quarter_idx, round(median(future_closure_rate), 9) AS median_rate, count(*) AS n FROM f_ok
WHERE future_closure_rate IS NOT NULL GROUP BY 1, 2""")
def closure_median(t):
    m = exact_median(S.training_rows(features(t)), ["industry_code", "quarter_idx"], "future_closure_rate", "median_rate")
    return m.withColumn("median_rate", F.round("median_rate", 9))


@query("median_label", ["f_sample"], f"SELECT {KEYS}, round(future_closure_rate, 9) AS future_closure_rate, label FROM f_sample")
def median_label(t):
    return samples(t).select(*P.KEY, F.round("future_closure_rate", 9).alias("future_closure_rate"), "label")


@query("time_split", ["f_split"], """
SELECT industry_code, part, min(quarter_idx) AS first_quarter, max(quarter_idx) AS last_quarter, count(*) AS row_count,
 CAST(sum(label) AS BIGINT) AS positives FROM f_split GROUP BY 1, 2""")
def time_split(t):
    return split(t).groupBy("industry_code", "part").agg(
        F.min("quarter_idx").alias("first_quarter"), F.max("quarter_idx").alias("last_quarter"),
        F.count(F.lit(1)).alias("row_count"), F.sum("label").alias("positives"))


@query("feature_scaling", ["f_split"], " UNION ALL ".join(
    f"SELECT industry_code, '{f}' AS key, round(avg({f}), 8) AS mean, round(stddev_samp({f}), 8) AS std FROM f_split WHERE part = 'train' GROUP BY 1"
    for f in S.FEATURES))
def feature_scaling(t):
    s = S.feature_scaling(split(t).where("part = 'train'"))
    cells = [F.struct(F.lit(f).alias("key"), F.round(f"mean_{f}", 8).alias("mean"), F.round(f"std_{f}", 8).alias("std"))
             for f in S.FEATURES]
    return s.select("industry_code", F.explode(F.array(*cells)).alias("c")).select("industry_code", "c.*")


_PAIRS = [(a, b) for i, a in enumerate(S.FEATURES) for b in S.FEATURES[i + 1:]]


@query("feature_corr", ["f_split"], "SELECT industry_code, left_key, right_key, round(r, 8) AS r, abs(r) >= 0.7 AS flagged FROM (" + " UNION ALL ".join(
    f"SELECT industry_code, '{a}' AS left_key, '{b}' AS right_key, corr({a}, {b}) AS r FROM f_split WHERE part = 'train' GROUP BY 1" for a, b in _PAIRS) + ")")
def feature_corr(t):
    return S.correlations(split(t).where("part = 'train'")).withColumn("r", F.round("r", 8))


@query("clipped_z", ["f_ok"], f"SELECT {KEYS}, " + ", ".join(f"round({_Z[f]}, 8) AS {f}" for f in S.FEATURES) + " FROM f_ok")
def clipped_z(t):
    return usable(t).select(*P.KEY, *[F.round(S.clipped_z(F.col(f), F.lit(m), F.lit(s)), 8).alias(f)
                                      for f, (b, m, s) in COEFFICIENTS.items()])


# ---------------------------------------------------------------- scoring

@query("survival_scores", ["f_scored"], f"SELECT {KEYS}, round(probability, 9) AS probability, score, grade FROM f_scored")
def survival_scores(t):
    return scored(t).select(*P.KEY, F.round("probability", 9).alias("probability"), "score", "grade")


@query("score_status", ["f_feat", "f_ok", "f_series"], """
SELECT s.area_type, s.area_code, s.industry_code, CASE WHEN f.area_code IS NULL THEN 'NO_DATA' WHEN reason IS NULL THEN 'SCORED'
 WHEN reason = 'FEW_STORES' THEN 'INSUFFICIENT_STORES' ELSE 'NO_DATA' END AS status, similar_store_count AS stores
FROM f_series s LEFT JOIN (SELECT * FROM f_feat WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok)) f ON f.area_code = s.area_code AND f.industry_code = s.industry_code""")
def score_status(t):
    f = latest(features(t)).select(*P.SERIES, "reason", F.col("similar_store_count").alias("stores"), F.lit(1).alias("_seen"))
    j = X.f_series(t).select(*P.SERIES).join(f, list(P.SERIES), "left")
    return j.select(*P.SERIES, F.when(F.col("_seen").isNull(), "NO_DATA").otherwise(S.score_status(F.col("reason"))).alias("status"),
                    "stores")


@query("score_rank", ["f_scored"], f"""
SELECT area_code, industry_code, score, rnk AS rank, total, CAST(greatest(1, ceil(rnk * 100.0 / total)) AS INTEGER) AS top_percent FROM (
 SELECT *, rank() OVER (PARTITION BY industry_code ORDER BY score DESC) AS rnk, count(*) OVER (PARTITION BY industry_code) AS total
 FROM f_scored WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok))""")
def score_rank(t):
    r = S.rank_scores(latest(scored(t)).select("area_code", "industry_code", "score"))
    return r.select("area_code", "industry_code", "score", "rank", "total", "top_percent")


@query("score_bins", ["f_scored"], """
SELECT i.industry_code, CAST(b * 10 AS INTEGER) AS bin_from, CAST(CASE WHEN b = 9 THEN 100 ELSE b * 10 + 9 END AS INTEGER) AS bin_to, count(score) AS row_count
FROM (SELECT DISTINCT industry_code FROM f_scored WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok)) i CROSS JOIN range(10) r(b)
LEFT JOIN (SELECT * FROM f_scored WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok)) s ON s.industry_code = i.industry_code AND least(9, score // 10) = b GROUP BY 1, 2, 3""")
def score_bins(t):
    return S.score_bins(latest(scored(t)))


@query("grade_counts", ["f_scored"], """
SELECT i.industry_code, g.grade, count(s.score) AS row_count FROM (SELECT DISTINCT industry_code FROM f_scored WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok)) i
CROSS JOIN (VALUES ('AAA'),('AA'),('A'),('BBB'),('BB'),('B'),('C'),('D')) g(grade)
LEFT JOIN (SELECT * FROM f_scored WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok)) s ON s.industry_code = i.industry_code AND s.grade = g.grade GROUP BY 1, 2""")
def grade_counts(t):
    return S.grade_counts(latest(scored(t)))


@query("monthly_revenue", ["f_ok"], f"""
SELECT {KEYS}, {half('window_sales', 'window_stores * 3')} AS quarter_total, {half('window_sales', 'window_stores')} AS monthly_average FROM f_ok""")
def monthly_revenue(t):
    a, b = F.col("window_sales"), F.col("window_stores")
    return usable(t).select(*P.KEY, S.monthly_revenue(a, b).alias("quarter_total"),
                            S.monthly_revenue(a, b, "QUARTER_MONTHLY_AVERAGE").alias("monthly_average"))


@query("display_values", ["f_shown"], f"SELECT {KEYS}, " + ", ".join(f"show_{f}" for f in S.FEATURES) + " FROM f_shown")
def display_values(t):
    return S.display_values(usable(t)).select(*P.KEY, *[f"show_{f}" for f in S.FEATURES])


@query("feature_averages", ["f_shown"], "SELECT industry_code, key, average FROM (" + " UNION ALL ".join(
    "SELECT industry_code, '{f}' AS key, {e} AS average FROM (SELECT industry_code, CAST(sum(show_{f}) AS HUGEINT) * {m} AS s, count(*) AS n FROM f_shown WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok) GROUP BY 1)".format(
        f=f, e=half("s", "n"), m=10 if f == "store_count_log" else 1) for f in S.FEATURES) + ")")
def feature_averages(t):
    return S.feature_averages(latest(S.display_values(usable(t))))


@query("revenue_range", ["f_shown"], """
SELECT industry_code, quantile_disc(show_sales_per_store, 0.01) AS low, quantile_disc(show_sales_per_store, 0.99) AS high, count(*) AS n
FROM f_shown GROUP BY 1""")
def revenue_range(t):
    return S.revenue_range(S.display_values(usable(t)))


@query("revenue_outlier", ["f_shown"], f"""
SELECT {KEYS}, v AS revenue, CASE WHEN v > hi THEN 'HIGH' WHEN v < lo THEN 'LOW' END AS outlier FROM (
 SELECT *, show_sales_per_store AS v FROM f_shown) s JOIN (SELECT industry_code AS ic, quantile_disc(show_sales_per_store, 0.01) AS lo,
 quantile_disc(show_sales_per_store, 0.99) AS hi FROM f_shown GROUP BY 1) r ON ic = industry_code""")
def revenue_outlier(t):
    shown = S.display_values(usable(t))
    j = shown.join(S.revenue_range(shown), "industry_code")
    v = F.col("show_sales_per_store")
    return j.select(*P.KEY, v.alias("revenue"), S.revenue_outlier(v, F.col("low"), F.col("high")).alias("outlier"))


@query("top_contrib", ["f_shown"], "SELECT area_code, industry_code, CAST(rn AS INTEGER) AS position, key, round(c, 8) AS contribution, CASE WHEN c >= 0 THEN 'RAISES' ELSE 'LOWERS' END AS effect, CASE WHEN v * m > average THEN 'HIGHER' WHEN v * m < average THEN 'LOWER' ELSE 'SAME' END AS comparison FROM (SELECT *, row_number() OVER (PARTITION BY area_code, industry_code ORDER BY abs(c) DESC, ord) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT x.area_code, x.industry_code, {i} AS ord, '{f}' AS key, -({COEFFICIENTS[f][0]}) * {_Z[f]} AS c, show_{f} AS v, {10 if f == 'store_count_log' else 1} AS m, average FROM f_shown x JOIN (SELECT industry_code, {half('s', 'n')} AS average FROM (SELECT industry_code, CAST(sum(show_{f}) AS HUGEINT) * {10 if f == 'store_count_log' else 1} AS s, count(*) AS n FROM f_shown WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok) GROUP BY 1)) a USING (industry_code) WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok)"
    for i, f in enumerate(S.FEATURES)) + ")) WHERE rn <= 4")
def top_contrib(t):
    rows = S.display_values(latest(scored(t)))
    avgs = S.feature_averages(rows)
    top = S.top_contributions(rows)
    value = None
    for f in S.FEATURES:
        v = F.col(f"show_{f}") * (10 if f == "store_count_log" else 1)
        value = F.when(F.col("key") == f, v) if value is None else value.when(F.col("key") == f, v)
    j = top.withColumn("_v", value).join(avgs, ["industry_code", "key"])
    return j.select("area_code", "industry_code", "position", "key", F.round("contribution", 8).alias("contribution"),
                    S.contribution_effect(F.col("contribution")).alias("effect"),
                    S.compare_to_average(F.col("_v"), F.col("average")).alias("comparison"))


@query("interpretation", None, """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'QUARTER_MONTHLY_AVERAGE' WHEN c_custkey % 3 = 1 THEN 'QUARTER_TOTAL'
 ELSE 'QUARTER_MONTHLY_AVERAGE' END AS interpretation, CASE WHEN c_custkey % 3 = 1 THEN 3 ELSE 1 END AS months FROM customer""")
def interpretation(t):
    k = F.col("c_custkey") % 3
    rec = F.when(k == 1, "QUARTER_TOTAL").when(k == 2, "QUARTER_MONTHLY_AVERAGE")
    out = S.recorded_interpretation(rec)
    months = None
    for name, m in S.MONTHS_PER_VALUE.items():
        months = F.when(F.col("interpretation") == name, m) if months is None else months.when(F.col("interpretation") == name, m)
    return t.customer.select("c_custkey", out.alias("interpretation")).withColumn("months", months)


# ---------------------------------------------------------------- evaluation

def scored_test(t):
    return S.score_rows(split(t).where("part = 'test'"), fixed_model(t))


@query("auc_exact", ["f_scored_test"], """
SELECT industry_code, round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2.0) / (p * n), 9) AS auc, p AS positives, n AS negatives FROM (
 SELECT *, rank() OVER (PARTITION BY industry_code ORDER BY probability) + (count(*) OVER (PARTITION BY industry_code, probability) - 1) / 2.0 AS r,
  count(*) FILTER (label = 1) OVER (PARTITION BY industry_code) AS p, count(*) FILTER (label = 0) OVER (PARTITION BY industry_code) AS n
 FROM (SELECT industry_code, label, round(probability, 9) AS probability FROM f_scored_test)) GROUP BY industry_code, p, n""")
def auc_exact(t):
    rows = scored_test(t).select("industry_code", "label", F.round("probability", 9).alias("p"))
    return S.auc(rows, ["industry_code"], "p", "label").withColumn("auc", F.round("auc", 9))


@query("ks_exact", ["f_scored_test"], """
SELECT industry_code, round(max(abs(cp / p - cn / n)), 9) AS ks FROM (
 SELECT industry_code, (count(*) FILTER (label = 1) OVER w)::DOUBLE AS cp, (count(*) FILTER (label = 0) OVER w)::DOUBLE AS cn,
  (count(*) FILTER (label = 1) OVER (PARTITION BY industry_code))::DOUBLE AS p, (count(*) FILTER (label = 0) OVER (PARTITION BY industry_code))::DOUBLE AS n
 FROM f_scored_test WINDOW w AS (PARTITION BY industry_code ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1""")
def ks_exact(t):
    return S.ks(scored_test(t), ["industry_code"], "score", "label", target=None).withColumn("ks", F.round("ks", 9))


_OUTCOME_SQL = """, o AS (SELECT i.industry_code, g.grade, g.ord AS grade_ord, count(s.score) AS row_count, avg(s.label) AS positive_rate,
 avg(s.future_closure_rate) AS mean_rate FROM (SELECT DISTINCT industry_code FROM f_scored_test) i
 CROSS JOIN (VALUES ('AAA',0),('AA',1),('A',2),('BBB',3),('BB',4),('B',5),('C',6),('D',7)) g(grade, ord)
 LEFT JOIN f_scored_test s ON s.industry_code = i.industry_code AND s.grade = g.grade GROUP BY 1, 2, 3)"""


@query("grade_outcomes", ["f_scored_test"], _OUTCOME_SQL + """
SELECT industry_code, grade, grade_ord, row_count, round(positive_rate, 9) AS positive_rate, round(mean_rate, 9) AS mean_rate FROM o""")
def grade_outcomes(t):
    return S.grade_outcomes(scored_test(t)).withColumn("positive_rate", F.round("positive_rate", 9)).withColumn(
        "mean_rate", F.round("mean_rate", 9))


@query("grade_monotonic", ["f_scored_test"], _OUTCOME_SQL + """
SELECT industry_code, bool_and(prev IS NULL OR positive_rate >= prev) AS monotonic, count(*) AS grades_used FROM (
 SELECT *, lag(positive_rate) OVER (PARTITION BY industry_code ORDER BY grade_ord) AS prev FROM o WHERE row_count >= 2) GROUP BY 1""")
def grade_monotonic(t):
    return S.is_monotonic(S.grade_outcomes(scored_test(t)), min_count=2)


@query("served_gate", ["f_scored_test", "f_scored"], """
, a AS (SELECT industry_code, (sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2.0) / (p * n) AS auc FROM (
 SELECT *, rank() OVER (PARTITION BY industry_code ORDER BY score) + (count(*) OVER (PARTITION BY industry_code, score) - 1) / 2.0 AS r,
  count(*) FILTER (label = 0) OVER (PARTITION BY industry_code) AS p, count(*) FILTER (label = 1) OVER (PARTITION BY industry_code) AS n
 FROM (SELECT industry_code, score, 1 - label AS label0, label FROM f_scored_test)) GROUP BY industry_code, p, n)
SELECT industry_code, count(*) AS served_rows FROM f_scored WHERE quarter_idx = (SELECT max(quarter_idx) FROM f_ok) AND industry_code IN (
 SELECT industry_code FROM (SELECT industry_code, (sum(CASE WHEN label = 0 THEN r END) - p * (p + 1) / 2.0) / (p * n) AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY industry_code ORDER BY score) + (count(*) OVER (PARTITION BY industry_code, score) - 1) / 2.0 AS r,
   count(*) FILTER (label = 0) OVER (PARTITION BY industry_code) AS p, count(*) FILTER (label = 1) OVER (PARTITION BY industry_code) AS n
  FROM f_scored_test) GROUP BY industry_code, p, n) WHERE auc >= 0.45) GROUP BY 1""")
def served_gate(t):
    """Industries whose score ranks survivors (label 0) well enough; the proxy's threshold is 0.45."""
    gate = S.served_industries(scored_test(t), min_auc=0.45, target=None)
    return latest(scored(t)).join(gate, "industry_code", "left_semi").groupBy("industry_code").agg(
        F.count(F.lit(1)).alias("served_rows"))


@query("wald_p", ["f_split"], """
SELECT industry_code, round(b / s, 6) AS ratio, round(2 * (1 - 0.5 * (1 + (1 - ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k
 - 0.284496736) * k + 0.254829592) * k * exp(-x * x)))), 8) AS p_value FROM (SELECT *, abs(b / s) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(b / s) / sqrt(2.0)) AS k FROM (
 SELECT industry_code, avg(past_closure_rate) - 0.12 AS b, stddev_samp(past_closure_rate) / sqrt(count(*)) AS s FROM f_split GROUP BY 1))""")
def wald_p(t):
    m = split(t).groupBy("industry_code").agg((F.avg("past_closure_rate") - 0.12).alias("b"),
                                              (F.stddev_samp("past_closure_rate") / F.sqrt(F.count(F.lit(1)))).alias("s"))
    return m.select("industry_code", F.round(F.col("b") / F.col("s"), 6).alias("ratio"),
                    F.round(S.wald_p(F.col("b"), F.col("s")), 8).alias("p_value"))


@query("logit_fit")
def logit_fit(t):
    rows = split(t).where("part = 'train'")
    z = FIT.standardise(rows, S.feature_scaling(rows)).select("industry_code", "label", *S.FEATURES).persist()
    try:
        return FIT.fit_logistic(z, {"survival": S.FEATURES})
    finally:
        z.unpersist()


@query("model_compare")
def model_compare(t):
    """Coefficients of the four models, and AUC / KS of each on the test quarters."""
    rows = split(t).select("industry_code", "label", "part", "future_closure_rate", *S.FEATURES).persist()
    fits = FIT.compare_models(rows)
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    scaling = S.feature_scaling(train)
    out = None
    for name, feats in S.COMPARISON_MODELS.items():
        s = S.score_rows(test, FIT.model_table(fits, scaling, name, feats), feats)
        one = (S.auc(s, ["industry_code"], "probability", "label").join(S.ks(s, ["industry_code"], "score", "label", target=None), "industry_code")
                .select("industry_code", F.lit(name).alias("model"), F.lit(len(feats)).alias("features"), "auc", "ks"))
        out = one if out is None else out.unionByName(one)
    return out


@query("training_report")
def training_report(t):
    """Per coefficient: size, error, p-value and whether its sign is the expected one."""
    return FIT.sign_agreement(FIT.compare_models(split(t))).select(
        "industry_code", "model", "name", "beta", "std_error", "p_value", "iterations", "converged", "expected", "agrees")
