"""Quarterly place x industry panel and the small reads over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.functions.money import int_div, wide

KEY = ("area_type", "area_code", "industry_code", "quarter_idx")
AREA = ("area_type", "area_code")
SERIES = ("area_type", "area_code", "industry_code")
SALES = ("sales_amount", "sales_count")
STORES = ("store_count", "similar_store_count", "franchise_store_count", "opened_store_count", "closed_store_count")


def build_panel(sales: DataFrame, stores: DataFrame, supported: Sequence[str] | None = None,
                keys: Sequence[str] = KEY) -> DataFrame:
    """Sales full-outer stores on the four-part key; a side that is absent stays null."""
    if supported is not None:
        sales = sales.where(F.col("industry_code").isin(*supported))
        stores = stores.where(F.col("industry_code").isin(*supported))
    return sales.join(stores, list(keys), "full_outer")


def join_audit(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Keys on both sides, on one side only, and keys that are not one-to-one.

    Both sides are counted per key in one aggregate instead of joined, so a repeated key
    cannot multiply rows.
    """
    both = (left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
            .unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
            .groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")))
    l, r = F.col("_l") > 0, F.col("_r") > 0
    return both.agg(F.count(F.when(l & r, 1)).alias("both"), F.count(F.when(l & ~r, 1)).alias("left_only"),
                    F.count(F.when(~l & r, 1)).alias("right_only"),
                    F.count(F.when((F.col("_l") > 1) | (F.col("_r") > 1), 1)).alias("not_one_to_one"))


def orphans(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``left`` without a row in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def complete_areas(areas: DataFrame, industries: DataFrame, facts: DataFrame,
                   keys: Sequence[str] = SERIES) -> DataFrame:
    """Every area x industry yields a row, with or without facts.

    The grid is what is asked for: one row for every area and supported industry, however many
    codes the caller's table has.
    """
    grid = areas.crossJoin(industries.select("industry_code").distinct())
    return grid.join(facts, list(keys), "left")


def check_identity(df: DataFrame, parts: Sequence[Column], total: Column, name: str = "identity_ok") -> DataFrame:
    """Flag rows whose parts do not add up; rows are kept."""
    acc = parts[0]
    for p in parts[1:]:
        acc = acc + p
    return df.withColumn(name, acc == total)


def data_status(grid: DataFrame, panel: DataFrame) -> DataFrame:
    """Per series: NOT_PROVIDED without rows, PARTIAL with a count of null sales, else AVAILABLE."""
    per = panel.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("quarters"),
                                     F.count(F.when(F.col("sales_amount").isNull(), 1)).alias("missing_sales"))
    j = grid.join(per, list(SERIES), "left").na.fill(0, ["quarters", "missing_sales"])
    return j.withColumn("data_status", F.when(F.col("quarters") == 0, "NOT_PROVIDED")
                        .when(F.col("missing_sales") > 0, "PARTIAL").otherwise("AVAILABLE"))


def district_counts(areas: DataFrame) -> DataFrame:
    return (areas.groupBy("district_code", "district_name").agg(F.count(F.lit(1)).alias("area_count"))
                 .orderBy("district_code"))


def latest_common_quarter(a: DataFrame, b: DataFrame, as_of_idx: int | Column, look_back: int = 8) -> DataFrame:
    """Newest quarter with rows on both sides, among the ``look_back`` ending at ``as_of_idx``."""
    ref = as_of_idx if isinstance(as_of_idx, Column) else F.lit(as_of_idx)
    inside = (F.col("quarter_idx") <= ref) & (F.col("quarter_idx") > ref - look_back)
    qa = a.where(inside).select("quarter_idx").distinct()
    qb = b.where(inside).select("quarter_idx").distinct()
    return qa.join(qb, "quarter_idx").agg(F.max("quarter_idx").alias("quarter_idx"))


def complete_keys(df: DataFrame, keys: Sequence[str], period: str, n: int) -> DataFrame:
    """How many keys are seen in all ``n`` periods, and how many at all."""
    per = df.select(*keys, period).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.count(F.when(F.col("_n") == n, 1)).alias("complete"), F.count(F.lit(1)).alias("observed"))


def breakdown_shares(points: DataFrame, group: Sequence[str], amount: str = "amount") -> DataFrame:
    """Share of a point in its group, cut to a tenth of a percent; zero when the group is zero."""
    total = F.coalesce(F.sum(amount).over(Window.partitionBy(*group)), F.lit(0))
    permille = int_div(wide(F.col(amount)) * 1000, wide(total))
    return points.withColumn("share_permille", F.when(total == 0, F.lit(0)).otherwise(permille).cast("bigint"))


def trend_stats(panel: DataFrame) -> DataFrame:
    """Observed quarters and series maximum; nulls count for neither."""
    return panel.groupBy(*SERIES).agg(F.count("sales_amount").alias("observed_quarters"),
                                      F.max("sales_amount").alias("max_sales"),
                                      F.max("store_count").alias("max_stores"))


def resolve_requests(requests: DataFrame, areas: DataFrame, industries: DataFrame) -> DataFrame:
    """Outcome per request row; the first failing check wins.

    Requests carry ``area_type`` (nullable), ``area_code`` and ``industry_code``.
    """
    from placemetrics.operators.quality import AREA_CODE_PATTERN, INDUSTRY_CODE_PATTERN

    per_code = areas.groupBy("area_code").agg(
        F.countDistinct("area_type").alias("_types"), F.min("area_type").alias("_type"))
    exact = areas.select(F.col("area_code").alias("_code"), F.col("area_type").alias("_exact")).distinct()
    ind = industries.select("industry_code", "supported").distinct()
    j = (requests.join(per_code, "area_code", "left")
         .join(exact, (F.col("area_code") == F.col("_code")) & (F.col("area_type") == F.col("_exact")), "left")
         .join(ind, "industry_code", "left"))
    typed = F.col("area_type").isNotNull()
    found = F.when(typed, F.col("_exact").isNotNull()).otherwise(F.col("_types") >= 1)
    outcome = (F.when(~F.coalesce(F.col("area_code").rlike(AREA_CODE_PATTERN), F.lit(False)), "INVALID_AREA_CODE")
               .when(~F.coalesce(F.col("industry_code").rlike(INDUSTRY_CODE_PATTERN), F.lit(False)), "INVALID_INDUSTRY_CODE")
               .when(~F.coalesce(found, F.lit(False)), "AREA_NOT_FOUND")
               .when(~typed & (F.col("_types") > 1), "AMBIGUOUS_AREA_CODE")
               .when(F.col("supported").isNull(), "INVALID_INDUSTRY_CODE")
               .when(~F.col("supported"), "UNSUPPORTED_INDUSTRY").otherwise("OK"))
    return j.select(*requests.columns, outcome.alias("outcome"),
                    F.when(outcome == "OK", F.coalesce("_exact", "_type")).alias("resolved_area_type"))
