"""Survival score: gap-aware features, labels, scoring and evaluation.

Everything about one (area, industry, quarter) cell comes from a single sort of its series:
the lag, the trailing window and the future window are RANGE frames over the quarter index,
so a missing quarter is seen as missing and is never skipped over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placemetrics.functions.money import half_up_div, int_div, wide
from placemetrics.functions.ranks import TARGET, competition_rank, exact_median, nearest_rank, running_totals
from placemetrics.operators.panel import SERIES
from placemetrics.session import cut

# Fixed values of the score definition.
MIN_STORE_COUNT = 5
LAG_QUARTERS = 4
WINDOW_QUARTERS = 4
HORIZON_QUARTERS = 4
TEST_QUARTERS = 4
Z_CLIP = 3.0
MIN_TEST_AUC = 0.6
MONOTONIC_MIN_COUNT = 30
CORRELATION_FLAG = 0.7
MONTHS_PER_VALUE = {"QUARTER_TOTAL": 3, "QUARTER_MONTHLY_AVERAGE": 1}
GRADE_BOUNDS = (("AAA", 90), ("AA", 80), ("A", 70), ("BBB", 60), ("BB", 50), ("B", 40), ("C", 30), ("D", 0))
REASONS = ("NO_DATA", "FEW_STORES", "NO_SALES", "NO_PRIOR_SALES", "INCOMPLETE_WINDOW", "FEATURE_UNAVAILABLE")
TRAINING_REASONS = (*REASONS, "NO_FUTURE_DATA")
FEATURES = ("sales_growth", "sales_per_store", "store_count_log", "past_closure_rate", "past_open_rate",
            "franchise_share")
FIRST_ORDER = FEATURES[:3]
COMPARISON_MODELS = {
    "baseline": ("past_closure_rate",),
    "firstOrder": FIRST_ORDER,
    "combined": ("past_closure_rate", *FIRST_ORDER),
    "survival": FEATURES,
}
EXPECTED_DIRECTION = {"sales_growth": 1, "sales_per_store": 1, "store_count_log": 0, "past_closure_rate": -1,
                      "past_open_rate": 0, "franchise_share": 0}


# ---------------------------------------------------------------- windows

def _series(first: int, last: int, by: Sequence[str] = SERIES):
    return Window.partitionBy(*by).orderBy("quarter_idx").rangeBetween(first, last)


def lag_exact(value: Column, n: int = LAG_QUARTERS, by: Sequence[str] = SERIES) -> Column:
    """Value exactly ``n`` quarters earlier; null when that quarter has no row."""
    return F.max(value).over(_series(-n, -n, by))


def sum_complete(value: Column, first: int, last: int, by: Sequence[str] = SERIES) -> Column:
    """Sum over a frame of quarters, null unless every quarter of it holds a value."""
    w = _series(first, last, by)
    return F.when(F.count(value).over(w) == last - first + 1, F.sum(value).over(w))


def future_rate(closed: Column, stores: Column, horizon: int = HORIZON_QUARTERS) -> Column:
    """Closures in the next quarters over stores now; null when any part is unknown or zero stores."""
    total = sum_complete(closed, 1, horizon)
    return F.when(stores > 0, total.cast("double") / stores)


def with_windows(panel: DataFrame) -> DataFrame:
    """Panel plus lagged, trailing and future sums; one shuffle by series, one sort."""
    sales, stores = F.col("sales_amount"), F.col("similar_store_count")
    w = _series(1 - WINDOW_QUARTERS, 0)
    both = F.when(sales.isNotNull() & stores.isNotNull(), 1)
    full = F.count(both).over(w) == WINDOW_QUARTERS
    prior_stores = lag_exact(stores)
    return panel.select(
        "*",
        lag_exact(sales).alias("prior_sales"),
        F.when(prior_stores > 0, prior_stores).alias("prior_stores"),
        F.when(full, F.sum(sales).over(w)).alias("window_sales"),
        F.when(full, F.sum(stores).over(w)).alias("window_stores"),
        sum_complete(F.col("closed_store_count"), 1 - WINDOW_QUARTERS, 0).alias("window_closed"),
        sum_complete(F.col("opened_store_count"), 1 - WINDOW_QUARTERS, 0).alias("window_opened"),
        future_rate(F.col("closed_store_count"), stores).alias("future_closure_rate"))


# ---------------------------------------------------------------- features and exclusions

def _d(name: str) -> Column:
    return F.col(name).cast("double")


# Registry of feature expressions over the columns of ``with_windows``; extend it with more
# Column expressions to add a feature.
FEATURE_EXPRESSIONS: dict[str, Callable[[], Column]] = {
    "sales_growth": lambda: F.log(_d("sales_amount")) - F.log(_d("prior_sales")),
    "sales_per_store": lambda: F.log(_d("window_sales") / (_d("window_stores") / WINDOW_QUARTERS)),
    "store_count_log": lambda: F.log(_d("similar_store_count")),
    "past_closure_rate": lambda: _d("window_closed") / F.col("prior_stores"),
    "past_open_rate": lambda: _d("window_opened") / F.col("prior_stores"),
    "franchise_share": lambda: _d("franchise_store_count") / F.col("similar_store_count"),
}


def exclusion_reason(features: Sequence[str] = FEATURES, min_stores: int = MIN_STORE_COUNT) -> Column:
    """First reason that keeps a cell out, in fixed precedence; null for a usable cell."""
    unavailable = None
    for name in features:
        bad = FEATURE_EXPRESSIONS[name]().isNull()
        unavailable = bad if unavailable is None else unavailable | bad
    return (F.when(F.col("similar_store_count").isNull(), "NO_DATA")
             .when(F.col("similar_store_count") < min_stores, "FEW_STORES")
             .when(F.col("sales_amount").isNull() | (F.col("sales_amount") <= 0), "NO_SALES")
             .when(F.col("prior_sales").isNull() | (F.col("prior_sales") <= 0), "NO_PRIOR_SALES")
             .when(F.col("window_sales").isNull(), "INCOMPLETE_WINDOW")
             .when(unavailable, "FEATURE_UNAVAILABLE"))


def build_features(panel: DataFrame, features: Sequence[str] = FEATURES,
                   min_stores: int = MIN_STORE_COUNT) -> DataFrame:
    """Windows, exclusion reason and feature values (null on excluded rows)."""
    reason = exclusion_reason(features, min_stores)
    out = with_windows(panel).withColumn("reason", reason)
    usable = F.col("reason").isNull()
    return out.select("*", *[F.when(usable, FEATURE_EXPRESSIONS[f]()).alias(f) for f in features])


def series_grid(panel: DataFrame, cells: DataFrame) -> DataFrame:
    """Every (series, quarter) of ``cells`` (the wanted series) over the panel's period."""
    span = panel.agg(F.min("quarter_idx").alias("_lo"), F.max("quarter_idx").alias("_hi"))
    return (cells.crossJoin(F.broadcast(span))     # one row
                 .select(*SERIES, F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int")))
                         .alias("quarter_idx")))


def training_reason() -> Column:
    """Exclusion for training: as for scoring, then NO_FUTURE_DATA."""
    return F.coalesce("reason", F.when(F.col("future_closure_rate").isNull(), F.lit("NO_FUTURE_DATA")))


def exclusion_counts(features: DataFrame, grid: DataFrame, by: Sequence[str] = ("industry_code", "quarter_idx"),
                     training: bool = True) -> DataFrame:
    """Zero-filled count of every reason per industry and quarter; absent cells are NO_DATA."""
    reasons = TRAINING_REASONS if training else REASONS
    reason = training_reason() if training else F.col("reason")
    marked = features.select(*SERIES, "quarter_idx", reason.alias("_reason"), F.lit(True).alias("_seen"))
    cells = grid.join(marked, [*SERIES, "quarter_idx"], "left")
    r = F.when(F.col("_seen").isNull(), F.lit("NO_DATA")).otherwise(F.col("_reason"))
    return cells.groupBy(*by).agg(*[F.count(F.when(r == x, 1)).alias(x.lower()) for x in reasons],
                                  F.count(F.when(r.isNull(), 1)).alias("ok"))


# ---------------------------------------------------------------- labels and split

def training_rows(features: DataFrame) -> DataFrame:
    return features.where(training_reason().isNull())


def label_by_median(samples: DataFrame, by: Sequence[str] = ("industry_code", "quarter_idx")) -> DataFrame:
    """Label 1 when the rate is strictly above the median of its industry and quarter."""
    samples = cut(samples)      # read for the median and joined back to it
    med = exact_median(samples, by, "future_closure_rate", "median_rate").drop("n")
    return samples.join(med, list(by)).withColumn(
        "label", (F.col("future_closure_rate") > F.col("median_rate")).cast("int"))


def labelled_span(panel: DataFrame) -> DataFrame:
    """First and last base quarter that can carry features and a label, and the first test quarter."""
    lo = F.min("quarter_idx") + LAG_QUARTERS
    hi = F.max("quarter_idx") - HORIZON_QUARTERS
    return panel.agg(lo.alias("first_base"), hi.alias("last_base"), (hi - TEST_QUARTERS + 1).alias("first_test"))


def split_by_time(samples: DataFrame, panel: DataFrame) -> DataFrame:
    """``part`` = train / test; the last four labelled quarters are the test set."""
    s = samples.crossJoin(F.broadcast(labelled_span(panel)))    # one row
    part = F.when(F.col("quarter_idx") >= F.col("first_test"), "test").otherwise("train")
    return (s.where((F.col("quarter_idx") >= F.col("first_base")) & (F.col("quarter_idx") <= F.col("last_base")))
             .withColumn("part", part).drop("first_base", "last_base", "first_test"))


# ---------------------------------------------------------------- scoring

def sigmoid(x: Column) -> Column:
    """Logistic function that does not overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def clipped_z(value: Column, mean: Column, std: Column, clip: float = Z_CLIP) -> Column:
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), (value - mean) / std))


def grade_of(score: Column, bounds: Sequence[tuple[str, int]] = GRADE_BOUNDS) -> Column:
    ordered = sorted(bounds, key=lambda b: -b[1])
    out = None
    for name, low in ordered:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out.otherwise(ordered[-1][0])


def score_rows(rows: DataFrame, model: DataFrame, features: Sequence[str] = FEATURES,
               bounds: Sequence[tuple[str, int]] = GRADE_BOUNDS) -> DataFrame:
    """Probability, score, grade and contributions.

    ``model`` has one row per industry: ``intercept`` and, per feature f, ``beta_f``,
    ``mean_f``, ``std_f``.
    """
    j = rows.join(model, "industry_code")
    z = {f: clipped_z(F.col(f), F.col(f"mean_{f}"), F.col(f"std_{f}")) for f in features}
    logit = F.col("intercept")
    for f in features:
        logit = logit + F.col(f"beta_{f}") * z[f]
    detail = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("key"), F.col(f).alias("value"),
                                z[f].alias("z"), (-F.col(f"beta_{f}") * z[f]).alias("contribution"))
                       for i, f in enumerate(features)])
    scored = j.select(*rows.columns, sigmoid(logit).alias("probability"), detail.alias("detail"))
    scored = scored.withColumn("score", F.floor((1 - F.col("probability")) * 100 + 0.5).cast("int"))
    return scored.withColumn("grade", grade_of(F.col("score"), bounds))


def score_status(reason: Column) -> Column:
    return (F.when(reason.isNull(), "SCORED").when(reason == "FEW_STORES", "INSUFFICIENT_STORES")
             .otherwise("NO_DATA"))


def top_percent(rank: Column, total: Column) -> Column:
    return F.greatest(F.lit(1), int_div(rank * 100 + total - 1, total)).cast("int")


def rank_scores(scored: DataFrame) -> DataFrame:
    out = competition_rank(scored, ["industry_code"], "score")
    return out.withColumn("top_percent", top_percent(F.col("rank"), F.col("total")))


def monthly_revenue(sales_sum: Column, store_sum: Column, interpretation: str = "QUARTER_TOTAL") -> Column:
    """Monthly revenue per store: multiply the divisor out, divide and round once."""
    return half_up_div(sales_sum, wide(store_sum) * MONTHS_PER_VALUE[interpretation])


def recorded_interpretation(recorded: Column) -> Column:
    """Missing -> the old reading; an unknown value stops the job."""
    known = recorded.isin(*MONTHS_PER_VALUE)
    return (F.when(recorded.isNull(), F.lit("QUARTER_MONTHLY_AVERAGE")).when(known, recorded)
             .otherwise(F.raise_error(F.concat(F.lit("unknown interpretation: "), recorded)).cast("string")))


def display_values(rows: DataFrame) -> DataFrame:
    """Display values as whole numbers: won, counts, and millionths for rates (half-up)."""
    micro = 1_000_000

    def rate(a: Column, b: Column) -> Column:
        return half_up_div(wide(a) * micro, b)

    return rows.select(
        "*",
        rate(F.col("sales_amount") - F.col("prior_sales"), F.col("prior_sales")).alias("show_sales_growth"),
        monthly_revenue(F.col("window_sales"), F.col("window_stores")).alias("show_sales_per_store"),
        F.col("similar_store_count").cast("bigint").alias("show_store_count_log"),
        rate(F.col("window_closed"), F.col("prior_stores")).alias("show_past_closure_rate"),
        rate(F.col("window_opened"), F.col("prior_stores")).alias("show_past_open_rate"),
        rate(F.col("franchise_store_count"), F.col("similar_store_count")).alias("show_franchise_share"))


def feature_averages(shown: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean of the displayed (rounded) values per industry and feature, half-up, in display units.

    Counts keep one digit and are therefore given in tenths.
    """
    sums = shown.groupBy("industry_code").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(wide(F.col(f"show_{f}"))).alias(f"_s_{f}") for f in features])
    cells = [F.struct(F.lit(f).alias("key"), half_up_div(
        F.col(f"_s_{f}") * (10 if f == "store_count_log" else 1), F.col("_n")).alias("average")) for f in features]
    return sums.select("industry_code", F.explode(F.array(*cells)).alias("c")).select("industry_code", "c.*")


def revenue_range(shown: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Nearest-rank bounds of the monthly revenue per industry."""
    return nearest_rank(shown, ["industry_code"], "show_sales_per_store", {"low": low, "high": high})


def revenue_outlier(value: Column, low: Column, high: Column) -> Column:
    return F.when(value > high, "HIGH").when(value < low, "LOW")


def top_contributions(scored: DataFrame, n: int = 4) -> DataFrame:
    """The ``n`` contributions of largest size per row; equal sizes keep feature order."""
    keyed = F.transform("detail", lambda d: F.struct(
        (-F.abs(d["contribution"])).alias("neg"), d["ord"].alias("ord"), d["key"].alias("key"),
        d["contribution"].alias("contribution")))
    top = F.slice(F.array_sort(keyed), 1, n)
    return scored.select(*[c for c in scored.columns if c != "detail"], F.posexplode(top).alias("pos", "_t")).select(
        *[c for c in scored.columns if c != "detail"], (F.col("pos") + 1).alias("position"),
        F.col("_t.key").alias("key"), F.col("_t.contribution").alias("contribution"))


def compare_to_average(value: Column, average: Column) -> Column:
    return F.when(value > average, "HIGHER").when(value < average, "LOWER").when(value == average, "SAME")


def contribution_effect(contribution: Column) -> Column:
    return F.when(contribution >= 0, "RAISES").otherwise("LOWERS")


# ---------------------------------------------------------------- summaries

def constant_rows(spark: SparkSession, **cols: Sequence) -> DataFrame:
    """A fixed small list as rows (grades, bins); its length is known in the code."""
    names = list(cols)
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in zip(names, row)]) for row in zip(*cols.values())]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("c")).select("c.*")


def grades_table(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, grade=[g for g, _ in GRADE_BOUNDS], grade_ord=list(range(len(GRADE_BOUNDS))))


def score_bins(scores: DataFrame) -> DataFrame:
    """Ten bins per industry, the last one closed at 100, zero-filled."""
    b = F.least(F.lit(9), F.floor(F.col("score") / 10)).cast("int")
    counts = scores.groupBy("industry_code", b.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    full = counts.select("industry_code").distinct().select(
        "industry_code", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    return full.join(counts, ["industry_code", "bin"], "left").select(
        "industry_code", (F.col("bin") * 10).alias("bin_from"),
        F.when(F.col("bin") == 9, F.lit(100)).otherwise(F.col("bin") * 10 + 9).alias("bin_to"),
        F.coalesce("_n", F.lit(0)).alias("row_count"))


def grade_counts(scores: DataFrame) -> DataFrame:
    grades = F.array(*[F.lit(g) for g, _ in GRADE_BOUNDS])
    counts = scores.groupBy("industry_code", "grade").agg(F.count(F.lit(1)).alias("_n"))
    full = counts.select("industry_code").distinct().select("industry_code", F.explode(grades).alias("grade"))
    return full.join(counts, ["industry_code", "grade"], "left").select(
        "industry_code", "grade", F.coalesce("_n", F.lit(0)).alias("row_count"))


def grade_outcomes(scored: DataFrame) -> DataFrame:
    """Per grade: rows, share of label 1 and mean true rate; null rates for an empty grade."""
    per = scored.groupBy("industry_code", "grade").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("label").alias("positive_rate"), F.avg("future_closure_rate").alias("mean_rate"))
    codes = per.select("industry_code").distinct()
    full = codes.select("industry_code", F.posexplode(F.array(*[F.lit(g) for g, _ in GRADE_BOUNDS]))
                        .alias("grade_ord", "grade"))
    return full.join(per, ["industry_code", "grade"], "left").select(
        "industry_code", "grade", "grade_ord", F.coalesce("_n", F.lit(0)).alias("row_count"), "positive_rate", "mean_rate")


def is_monotonic(outcomes: DataFrame, min_count: int = 1) -> DataFrame:
    """Does the positive rate never fall from the best grade to the worst? Eight rows per industry."""
    w = Window.partitionBy("industry_code").orderBy("grade_ord")
    kept = outcomes.where((F.col("row_count") >= min_count) & F.col("positive_rate").isNotNull())
    step = kept.withColumn("_prev", F.lag("positive_rate").over(w))
    return step.groupBy("industry_code").agg(
        F.bool_and(F.col("_prev").isNull() | (F.col("positive_rate") >= F.col("_prev"))).alias("monotonic"),
        F.count(F.lit(1)).alias("grades_used"))


# ---------------------------------------------------------------- evaluation

def served_industries(test: DataFrame, min_auc: float = MIN_TEST_AUC, target: int | None = TARGET) -> DataFrame:
    """Industries whose score ranks survivors (label 0) well enough on the test rows to be shown at all."""
    ranked = test.select("industry_code", "score", (1 - F.col("label")).alias("survived"))
    return auc(ranked, ["industry_code"], "score", "survived", target).where(F.col("auc") >= min_auc).select("industry_code")



def _class_totals(df: DataFrame, by: Sequence[str], score: str, label: str,
                  target: int | None) -> DataFrame:
    pairs = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"),
                                       F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))
    return running_totals(pairs, by, score, ["pos", "neg"], target)


def _need_both(total_pos: Column, total_neg: Column, value: Column) -> Column:
    return F.when((total_pos > 0) & (total_neg > 0), value).otherwise(
        F.raise_error(F.lit("both classes are needed")).cast("double"))


def auc(df: DataFrame, by: Sequence[str], score: str, label: str, target: int | None = TARGET) -> DataFrame:
    """Exact AUC; tied scores take their average rank. Ranks are kept doubled, so all sums are whole."""
    c = _class_totals(df, by, score, label, target)
    n, cum = F.col("pos") + F.col("neg"), F.col("cum_pos") + F.col("cum_neg")
    agg = c.groupBy(*by).agg(F.sum(wide(F.col("pos")) * (cum * 2 - n + 1)).alias("_r2"),
                             F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n"))
    p, m = wide(F.col("_p")), wide(F.col("_n"))
    value = (F.col("_r2") - p * (p + 1)).cast("double") / (2 * F.col("_p").cast("double") * F.col("_n"))
    return agg.select(*by, _need_both(p, m, value).alias("auc"), F.col("_p").alias("positives"),
                      F.col("_n").alias("negatives"))


def ks(df: DataFrame, by: Sequence[str], score: str, label: str, target: int | None = TARGET) -> DataFrame:
    """Largest distance of the two cumulative distributions over distinct scores."""
    c = _class_totals(df, by, score, label, target)
    gap = F.abs(F.col("cum_pos") / F.col("total_pos") - F.col("cum_neg") / F.col("total_neg"))
    return c.groupBy(*by).agg(F.max(_need_both(F.col("total_pos"), F.col("total_neg"), gap)).alias("ks"))


def feature_scaling(samples: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and sample standard deviation per industry and feature."""
    agg = samples.groupBy("industry_code").agg(*[e for f in features for e in (
        F.avg(f).alias(f"mean_{f}"), F.stddev_samp(f).alias(f"std_{f}"))])
    return agg


def correlations(samples: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Pearson correlation of every feature pair per industry, flagged from 0.7."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    agg = samples.groupBy("industry_code").agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("left_key"), F.lit(b).alias("right_key"), F.col(f"c{i}").alias("r"))
             for i, (a, b) in enumerate(pairs)]
    return (agg.select("industry_code", F.explode(F.array(*cells)).alias("c")).select("industry_code", "c.*")
               .withColumn("flagged", F.abs("r") >= CORRELATION_FLAG))


def wald_p(beta: Column, se: Column) -> Column:
    """Two-sided p-value by the Abramowitz-Stegun 7.1.26 polynomial (error below 1.5e-7)."""
    # The published polynomial's coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(beta / se) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = (poly + k) * t
    erf = 1 - poly * F.exp(-x * x)
    return 2 * (1 - 0.5 * (1 + erf))
