"""Verification of values read from notices: quotes, value checks, work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.text import compact_quote
from placemetrics.operators.notices import MAX_TEXT_CHARS, real_date
from placemetrics.operators.quality import first_reason

# Choices of the condition fields.
MIN_QUOTE_CHARS = 4
STAGES = ("PRE_STARTUP_ONLY", "BUSINESS_ONLY", "BOTH")
FOOD = ("EXCLUDED", "NOT_EXCLUDED")
SCOPES = ("NATIONWIDE", "PROVINCES", "SEOUL_DISTRICTS")
GROUPS = ("YOUTH", "WOMEN", "DISABLED", "RESTART", "DAMAGED", "OTHER")
SUPPORT = ("LOAN", "GUARANTEE", "GRANT", "SPACE", "PROGRAM", "OTHER")
AGE_LIMIT, BUSINESS_AGE_LIMIT = 120, 100
CAPITAL = "서울"


def verify_quotes(answers: DataFrame, texts: DataFrame, key: str, min_len: int = MIN_QUOTE_CHARS, fold=compact_quote) -> DataFrame:
    """Add ``quote_status``: NOT_MENTIONED, NO_VALUE, TOO_SHORT, NOT_FOUND or VERIFIED.

    Answers: key, field, mentioned, has_value, quote. Texts: key, title, body. Title and body are
    compacted once per notice before the join, so a long text is folded once however many
    fields quote it; a quote that spans both is not found.
    """
    t = texts.select(key, fold(F.col("title")).alias("_title"), fold(F.col("body")).alias("_body"))
    a = answers.withColumn("_q", fold(F.coalesce("quote", F.lit(""))))
    j = a.join(t, key, "left")
    q = F.col("_q")
    found = F.coalesce(F.col("_title").contains(q), F.lit(False)) | F.coalesce(F.col("_body").contains(q), F.lit(False))
    status = (F.when(~F.col("mentioned"), "NOT_MENTIONED")
              .when(~F.col("has_value") | (F.trim(F.coalesce("quote", F.lit(""))) == ""), "NO_VALUE")
              .when(F.length(q) < min_len, "TOO_SHORT").when(~found, "NOT_FOUND").otherwise("VERIFIED"))
    return j.withColumn("quote_status", status).drop("_q", "_title", "_body")


def range_reason(lo: Column, hi: Column, exclusive: Column, low: int, high: int, whole: bool = False) -> Column:
    """Why a range is no good: not whole, out of bounds, or empty."""
    def outside(b: Column) -> Column:
        return F.coalesce(~b.between(low, high) | F.isnan(b), F.lit(False))

    floor = F.coalesce(lo, F.lit(low).cast("double"))
    empty = F.when(exclusive, floor >= hi).otherwise(floor > hi)
    rules = [("OUT_OF_BOUNDS", outside(lo) | outside(hi)), ("EMPTY_RANGE", F.coalesce(empty, F.lit(False)))]
    if whole:
        part = F.coalesce(lo != F.floor(lo), F.lit(False)) | F.coalesce(hi != F.floor(hi), F.lit(False))
        rules.insert(0, ("NOT_WHOLE", part))
    return first_reason(rules)


def enum_reason(value: Column, options: Sequence[str]) -> Column:
    return F.when(~F.coalesce(value.isin(*options), F.lit(False)), "NOT_AN_OPTION")


def list_reason(values: Column, options: Sequence[str], need_one: bool) -> Column:
    wrong = F.size(F.array_except(values, F.array(*[F.lit(o) for o in options]))) > 0
    rules = [("EMPTY_LIST", F.size(values) == 0)] if need_one else []
    return first_reason([*rules, ("NOT_AN_OPTION", wrong)])


def region_reason(scope: Column, provinces: Column, districts: Column, excluded_districts: Column,
                  known_provinces: Sequence[str], known_districts: Sequence[str]) -> Column:
    """Consistency of a region value."""
    unknown_p = F.size(F.array_except(provinces, F.array(*[F.lit(p) for p in known_provinces]))) > 0
    any_district = (F.size(districts) > 0) | (F.size(excluded_districts) > 0)
    capital_only = (F.size(F.array_distinct(provinces)) == 1) & F.array_contains(provinces, CAPITAL)
    unknown_d = F.size(F.array_except(F.concat(districts, excluded_districts), F.array(*[F.lit(d) for d in known_districts]))) > 0
    return first_reason([
        ("NOT_AN_OPTION", ~F.coalesce(scope.isin(*SCOPES), F.lit(False))), ("UNKNOWN_PROVINCE", unknown_p),
        ("NATIONWIDE_WITH_PROVINCES", (scope == "NATIONWIDE") & (F.size(provinces) > 0)),
        ("PROVINCES_MISSING", (scope == "PROVINCES") & (F.size(provinces) == 0)),
        ("DISTRICTS_MISSING", (scope == "SEOUL_DISTRICTS") & (F.size(districts) == 0)),
        ("DISTRICTS_NOT_ALLOWED", (scope != "SEOUL_DISTRICTS") & (F.size(districts) > 0)),
        ("NOT_THE_CAPITAL", ~capital_only & any_district), ("UNKNOWN_DISTRICT", unknown_d)])


def period_reason(start: Column, end: Column, text: Column) -> Column:
    def bad(c: Column) -> Column:
        return c.isNotNull() & real_date(c).isNull()

    return first_reason([
        ("NO_PERIOD", start.isNull() & end.isNull() & (F.trim(F.coalesce(text, F.lit(""))) == "")),
        ("NOT_A_DATE", bad(start) | bad(end)), ("REVERSED", F.coalesce(start > end, F.lit(False)))])


def districts_quoted(districts: Column, quote: Column, title: Column) -> Column:
    """Every district name occurs in the quote or in the title (all three compacted)."""
    return F.forall(districts, lambda d: quote.contains(d) | title.contains(d))


def extraction_worklist(targets: DataFrame, cache: DataFrame, texts: DataFrame, model: str, prompt: str,
                        limit: int = MAX_TEXT_CHARS) -> DataFrame:
    """CACHED / NO_TEXT / TOO_LONG / TO_DO per (product, text checksum)."""
    done = (cache.where((F.col("model") == model) & (F.col("prompt_version") == prompt))
                 .select("product_key", "text_checksum", F.lit(True).alias("_done")).distinct())
    size = texts.select("product_key", "text_checksum", F.length("text").alias("_len"))
    j = targets.join(done, ["product_key", "text_checksum"], "left").join(size, ["product_key", "text_checksum"], "left")
    return j.withColumn("work", F.when(F.col("_done"), "CACHED").when(F.col("_len").isNull(), "NO_TEXT")
                        .when(F.col("_len") > limit, "TOO_LONG").otherwise("TO_DO")).drop("_done", "_len")
