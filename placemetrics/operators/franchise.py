"""Franchise brand-year statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.functions.money import half_up_div
from placemetrics.operators.rent import lookup

# The large category in scope and its middle categories by market industry.
FOOD_SERVICE = "외식"
MIDDLE_TO_MARKET = {"한식": "CS100001", "커피": "CS100010", "음료 (커피 외)": "CS100010"}
BRAND_KEY = ("corp_name", "brand_name", "industry_middle")
YEAR_KEY = ("year", *BRAND_KEY)
COSTS = ("franchise_fee", "education_fee", "deposit", "other_cost", "startup_total")
ACTIVITY = ("store_count", "new_store_count", "contract_end_count", "contract_cancel_count", "ownership_change_count")


def scope_map(rows: DataFrame) -> DataFrame:
    """Food-service rows of a known middle category, with their market industry."""
    out = rows.where(F.col("industry_large") == FOOD_SERVICE).withColumn(
        "market_industry", lookup(F.col("industry_middle"), MIDDLE_TO_MARKET))
    return out.where(F.col("market_industry").isNotNull())


def undisclosed_to_null(rows: DataFrame, sales: Sequence[str] = ("average_sales",), costs: Sequence[str] = ()) -> DataFrame:
    """Zero sales mean undisclosed; costs are undisclosed only when all of them are zero."""
    out = rows
    for c in sales:
        out = out.withColumn(c, F.nullif(F.col(c), F.lit(0)))
    if costs:
        disclosed = F.greatest(*[F.col(c) for c in costs]) > 0
        for c in costs:
            out = out.withColumn(f"_{c}", F.when(disclosed, F.col(c)))
        out = out.drop(*costs).withColumnsRenamed({f"_{c}": c for c in costs})
    return out


def count_undisclosed(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.when((F.col("store_count") > 0) & F.col("average_sales").isNull(), 1)).alias("undisclosed_sales"))


def join_costs(stores: DataFrame, costs: DataFrame) -> DataFrame:
    """Stores with optional start-up costs, one to one on the brand-year key."""
    return stores.join(costs.select(*YEAR_KEY, *COSTS, F.lit(True).alias("has_costs")), list(YEAR_KEY), "left").withColumn(
        "has_costs", F.coalesce("has_costs", F.lit(False)))


def cost_join_counts(stores: DataFrame, costs: DataFrame) -> DataFrame:
    """Matched cost rows and cost rows left over."""
    left = costs.join(stores.select(*YEAR_KEY, F.lit(1).alias("_s")), list(YEAR_KEY), "left")
    return left.agg(F.count("_s").alias("matched"), F.count(F.when(F.col("_s").isNull(), 1)).alias("unmatched"))


def year_stats(rows: DataFrame) -> DataFrame:
    """Display values of a brand-year: performance year, whether a status was reported, won amounts."""
    reported = F.col("average_sales").isNotNull()
    for c in ACTIVITY:
        reported = reported | (F.coalesce(F.col(c), F.lit(0)) > 0)
    won = F.col("average_sales").cast("bigint") * 1000
    return rows.select(*rows.columns, (F.col("year") - 1).alias("performance_year"), reported.alias("status_reported"),
                       won.alias("average_sales_won"), half_up_div(won, F.lit(12)).alias("monthly_sales_won"))


def with_history(rows: DataFrame, selected: DataFrame, latest_year: int) -> DataFrame:
    """All years of the selected brands, oldest first, one row per brand-year with its position.

    History is at most one row per year and brand, so the window over a brand is short.
    """
    keys = selected.where(F.col("year") == latest_year).select(*BRAND_KEY).distinct()
    w = Window.partitionBy(*BRAND_KEY).orderBy("year")
    return rows.join(keys, list(BRAND_KEY), "left_semi").withColumn("position", F.row_number().over(w))


def brand_order() -> list[Column]:
    return [F.desc("store_count"), F.asc("brand_name"), F.asc("corp_name")]


def top_brands(rows: DataFrame, n: int) -> DataFrame:
    """First ``n`` brands per market industry with the number of all matches.

    The row number filter becomes a per-partition limit before the shuffle; the totals are a
    separate aggregate, so no industry is held in one task.
    """
    w = Window.partitionBy("market_industry").orderBy(*brand_order(), "industry_middle")
    top = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
    totals = rows.groupBy("market_industry").agg(F.count(F.lit(1)).alias("total_matches"))
    return top.join(totals, "market_industry")


def brand_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("market_industry").agg(
        F.count(F.lit(1)).alias("brand_count"), F.count(F.when(F.col("store_count") > 0, 1)).alias("brands_with_stores"),
        F.count("average_sales").alias("brands_with_sales"))


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose brand or company contains the text, ignoring case."""
    q = F.lower(F.lit(text))
    return rows.where(F.lower("brand_name").contains(q) | F.lower("corp_name").contains(q))


GRAM = 3


def search_many(rows: DataFrame, requests: DataFrame, row_id: str) -> DataFrame:
    """(query, row id) pairs of substring hits for a table of queries.

    A hit must hold the query's first characters, so both sides meet in an equi-join on short
    character grams of the names, and ``contains`` confirms: no row meets every query.
    """
    names = rows.select(row_id, F.explode(F.array(F.lower("brand_name"), F.lower("corp_name"))).alias("_name"))

    def of_size(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("_name") - (size - 1))
        cut = F.transform(starts, lambda i: F.substring("_name", i, F.lit(size)))
        return F.when(F.length("_name") >= size, cut).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*[of_size(size) for size in range(1, GRAM + 1)])
    wanted_sizes = requests.select(F.lower("query").alias("_q"), "query").where(F.length("query") > 0)
    wanted = wanted_sizes.withColumn("_gram", F.substring("_q", 1, GRAM))
    left = names.select(row_id, "_name", F.explode(F.array_distinct(grams)).alias("_gram"))
    return (left.join(wanted, "_gram").where(F.col("_name").contains(F.col("_q")))
                .select("query", row_id).distinct())
