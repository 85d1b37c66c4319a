"""Business directory: categories, competition lists and profile resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.operators.quality import issue_array

# Category rules and terms.
COFFEE_CODE = "I21201"
COFFEE_PATTERN = "커피|카페|다방"
KOREAN_FOOD_PATTERN = "한식"
MEAT_TERMS = ("소고기", "돼지고기", "닭/오리", "곱창", "족발", "보쌈", "육류", "고기")
COFFEE_INDUSTRY, KOREAN_INDUSTRY = "CS100010", "CS100001"
REQUIRED = ("business_id", "business_name", "small_code", "small_name", "district_code", "district_name")
CATEGORY = ("small_code", "small_name", "middle_code", "middle_name", "market_industry")
LIST_LIMIT = 50


def map_category(middle_name: Column, small_code: Column, small_name: Column) -> Column:
    """Market industry of a detailed category; the coffee rule comes first."""
    return (F.when((small_code == COFFEE_CODE) | small_name.rlike(COFFEE_PATTERN), COFFEE_INDUSTRY)
             .when(middle_name.rlike(KOREAN_FOOD_PATTERN), KOREAN_INDUSTRY))


def is_meat(name: Column) -> Column:
    return F.greatest(*[name.contains(t).cast("int") for t in MEAT_TERMS]) == 1


def validate_directory(rows: DataFrame, optional: Sequence[str]) -> DataFrame:
    """Trim everything, blank optional fields become null, blank required fields become issues."""
    out = rows
    for c in REQUIRED:
        out = out.withColumn(c, F.trim(F.coalesce(F.col(c), F.lit(""))))
    for c in optional:
        out = out.withColumn(c, F.nullif(F.trim(c), F.lit("")))
    return out.withColumn("issues", issue_array([(f"MISSING_{c.upper()}", F.col(c) == "") for c in REQUIRED]))


def category_counts(rows: DataFrame) -> DataFrame:
    """Businesses per detailed category of a market industry."""
    return (rows.where(F.col("market_industry").isNotNull()).groupBy(*CATEGORY)
                .agg(F.count(F.lit(1)).alias("business_count")).withColumn("meat_category", is_meat(F.col("small_name")))
                .orderBy("market_industry", "small_name"))


def competition(rows: DataFrame, n: int = LIST_LIMIT) -> DataFrame:
    """For every (district, category): its size, whether the list is cut, and the first ``n`` businesses.

    The list is a per-group row-number limit, applied before the shuffle as well as after it;
    sizes are a separate aggregate.
    """
    key = ["district_code", "small_code"]
    rows = rows.where(F.col("market_industry").isNotNull())
    w = Window.partitionBy(*key).orderBy("business_name", "business_id")
    listed = (rows.select(*key, "business_name", "business_id").withColumn("position", F.row_number().over(w))
                  .where(F.col("position") <= n))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("business_count"))
    return listed.join(sizes, key).withColumn("truncated", F.col("business_count") > n)


def resolve_profiles(profiles: DataFrame, industries: DataFrame, businesses: DataFrame,
                     market_release: str, directory_release: str) -> DataFrame:
    """Resolve industry and detailed category of each profile, with release keys as provenance."""
    ind = industries.select("industry_code", "industry_name", "supported")
    details = businesses.where(F.col("market_industry").isNotNull()).groupBy("small_code", "market_industry").agg(
        F.min("small_name").alias("detail_name"))
    j = profiles.join(ind, "industry_code", "left").join(
        details.withColumnsRenamed({"small_code": "detail_code", "market_industry": "industry_code"}),
        ["detail_code", "industry_code"], "left")
    outcome = (F.when(~F.coalesce("supported", F.lit(False)), "INDUSTRY_NOT_FOUND")
               .when(F.col("detail_code").isNotNull() & F.col("detail_name").isNull(), "DETAIL_MISMATCH").otherwise("OK"))
    ok = outcome == "OK"
    return j.select(*profiles.columns, outcome.alias("outcome"), F.when(ok, F.col("industry_name")).alias("industry_name"),
                    F.when(ok, F.col("detail_name")).alias("detail_name"), F.when(ok, F.lit(market_release)).alias("market_release"),
                    F.when(ok & F.col("detail_name").isNotNull(), F.lit(directory_release)).alias("directory_release"))
