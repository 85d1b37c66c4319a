"""Row and table validation: issue arrays, quarantine, ledgers, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.functions.quarter import QUARTER_PATTERN

# Formats and code sets of the source tables.
AREA_TYPES = ("A", "D", "R", "U")
AREA_CODE_PATTERN = r"^\d{7}$"
DISTRICT_CODE_PATTERN = r"^\d{5}$"
INDUSTRY_CODE_PATTERN = r"^[A-Z]{2}\d{6}$"
MAX_SAFE_INTEGER = 9007199254740991
MAX_EXAMPLES = 50


class ValidationFailed(ValueError):
    """Raised when a gate finds at least one error-level issue."""


# ---------------------------------------------------------------- issue arrays

def issue_array(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all rules whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def first_reason(rules: Sequence[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    """Code of the first rule whose condition holds."""
    out = None
    for code, cond in rules:
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out if otherwise is None else out.otherwise(otherwise)


def missing_or(cond: Column) -> Column:
    """A failed test, where a null outcome is a failure as well."""
    return ~F.coalesce(cond, F.lit(False))


def split_by_issues(df: DataFrame, issues: str = "issues") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and one quarantine row per issue of the others."""
    ok = df.where(F.size(issues) == 0).drop(issues)
    bad = df.select(*[c for c in df.columns if c != issues], F.explode(issues).alias("code"))
    return ok, bad


# ---------------------------------------------------------------- keys and cells

def with_key_issues(df: DataFrame, area_types: Sequence[str] = AREA_TYPES) -> DataFrame:
    """One issue per failing part of the four-part key; key parts are trimmed."""
    out = df
    for c in ("quarter", "area_type", "area_code", "industry_code"):
        out = out.withColumn(c, F.trim(F.coalesce(c, F.lit(""))))
    return out.withColumn("issues", issue_array([
        ("INVALID_QUARTER", ~F.col("quarter").rlike(QUARTER_PATTERN)),
        ("INVALID_AREA_TYPE", ~F.col("area_type").isin(*area_types)),
        ("INVALID_AREA_CODE", ~F.col("area_code").rlike(AREA_CODE_PATTERN)),
        ("INVALID_INDUSTRY_CODE", ~F.col("industry_code").rlike(INDUSTRY_CODE_PATTERN)),
    ]))


def _number_cell(cell: Column, non_numeric: str) -> tuple[Column, Column]:
    t = F.trim(F.coalesce(cell, F.lit("")))
    status = (F.when(t == "", non_numeric).when(t.startswith("-"), "NEGATIVE_AMOUNT")
               .when(~t.rlike(r"^\d+$"), non_numeric))
    digits = F.regexp_replace(t, r"^0+(?=\d)", "")
    return status, digits


def parse_amount(cell: Column) -> Column:
    """``struct(issue, value)``: an exact DECIMAL(18,0), or why it is none."""
    status, digits = _number_cell(cell, "NON_NUMERIC_AMOUNT")
    value = digits.try_cast("decimal(18,0)")
    status = F.coalesce(status, F.when(value.isNull(), F.lit("NON_NUMERIC_AMOUNT")))
    return F.struct(status.alias("issue"), F.when(status.isNull(), value).alias("value"))


def parse_count(cell: Column) -> Column:
    """As :func:`parse_amount` for counts up to the largest safe integer."""
    status, digits = _number_cell(cell, "NON_NUMERIC_COUNT")
    value = digits.try_cast("decimal(20,0)")
    status = F.coalesce(status, F.when(value.isNull() | (value > MAX_SAFE_INTEGER), F.lit("NON_NUMERIC_COUNT")))
    return F.struct(status.alias("issue"), F.when(status.isNull(), value.cast("bigint")).alias("value"))


def api_number_cell(value: Column) -> Column:
    """Text of a JSON number; null becomes empty, an unsafe whole number is marked."""
    v = value.cast("decimal(38,0)")
    return (F.when(value.isNull(), F.lit(""))
             .when(value != v, value.cast("string"))        # a fraction stays as it is, and is no amount
             .when(F.abs(v) > MAX_SAFE_INTEGER, F.concat(F.lit("UNSAFE:"), v.cast("string")))
             .otherwise(v.cast("string")))


def parse_breakdown(count_cell: Column, amounts: Column, counts: Column) -> Column:
    """Breakdown cells of a row: all absent -> ABSENT, all parse -> OK, else REJECTED."""
    def blank(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    parsed = F.transform(F.concat(amounts, counts), parse_amount)
    head = parse_amount(count_cell)
    nothing = blank(count_cell) & F.forall(amounts, blank) & F.forall(counts, blank)
    bad = F.coalesce(head["issue"], F.get(F.filter(
        F.transform(parsed, lambda p: p["issue"]), lambda i: i.isNotNull()), F.lit(0)))
    return F.struct(
        F.when(nothing, "ABSENT").when(bad.isNotNull(), "REJECTED").otherwise("OK").alias("status"),
        F.when(~nothing, bad).alias("issue"),
        F.when(~nothing & bad.isNull(), F.transform(
            F.transform(amounts, parse_amount), lambda p: p["value"])).alias("amounts"))


# ---------------------------------------------------------------- duplicates

def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key by ``order``, with ``copies`` = rows seen for the key.

    A ``min`` over a struct combines on the map side, so a key with very many copies costs
    one row per input partition, not one sorted partition.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return agg.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)], "copies")


def later_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that :func:`dedupe_first` leaves out: quarantine, order must be unique in a key."""
    first = (df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
               .where("_n > 1").select(*keys, "_first"))
    return df.join(first, list(keys)).where(F.struct(*order) > F.col("_first")).drop("_first")


# ---------------------------------------------------------------- ledgers and gates

def issue_ledger(issues: DataFrame, order: str, code: str = "code", limit: int = MAX_EXAMPLES) -> DataFrame:
    """Count per code with the first ``limit`` examples in order.

    ``row_number() <= limit`` is cut per input partition before the shuffle by Spark's
    window group limit, so a code on a third of all rows still ships few rows.
    """
    w = Window.partitionBy(code).orderBy(order)
    samples = (issues.select(code, order).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
                     .groupBy(code).agg(F.array_sort(F.collect_list(order)).alias("examples")))
    counts = issues.groupBy(code).agg(F.count(F.lit(1)).alias("issue_count"))
    return counts.join(samples, code)


def fail_if_errors(ledger: DataFrame, code: str = "code", count: str = "issue_count") -> None:
    """Stop the job when the ledger (one row per issue code) is not empty."""
    rows = ledger.select(code, count).orderBy(code).collect()      # one row per code of the fixed list
    if rows:
        raise ValidationFailed(", ".join(f"{r[0]} {r[1]}" for r in rows))


def check_table(actuals: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """One-row table of measures -> (name, expected, actual, passed) rows."""
    pairs = [F.struct(F.lit(k).alias("name"), F.lit(v).cast("bigint").alias("expected"),
                      F.col(k).cast("bigint").alias("actual")) for k, v in expected.items()]
    return (actuals.select(F.explode(F.array(*pairs)).alias("c")).select("c.*")
                   .withColumn("passed", F.col("expected").eqNullSafe(F.col("actual"))))


def check_coverage(df: DataFrame, idx: str, start: int | Column, end: int | Column) -> DataFrame:
    """Periods requested but absent (MISSING) and present but not requested (UNEXPECTED)."""
    s = start if isinstance(start, Column) else F.lit(start)
    e = end if isinstance(end, Column) else F.lit(end)
    spark = df.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(s.cast("int"), e.cast("int"))).alias(idx))
    seen = df.select(F.col(idx).cast("int").alias(idx)).distinct()
    return (wanted.join(seen, idx, "left_anti").select(idx, F.lit("MISSING").alias("outcome"))
                  .unionByName(seen.join(wanted, idx, "left_anti").select(idx, F.lit("UNEXPECTED").alias("outcome"))))


def sibling_sets(df: DataFrame, group: Sequence[str], member: str, value: str) -> DataFrame:
    """Do all members of a group hold the same set of values?

    No set is collected: the sets agree exactly when (member, value) pairs = members x values.
    """
    pairs = df.select(*group, member, value).where(F.col(value).isNotNull()).distinct()
    per_value = pairs.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_m"))
    values = per_value.groupBy(*group).agg(F.count(F.lit(1)).alias("values"), F.sum("_m").alias("pairs"))
    members = df.select(*group, member).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("members"))
    return members.join(values, list(group), "left").select(
        *group, "members", F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("pairs", F.lit(0)).alias("pairs"),
        (F.col("members") * F.coalesce("values", F.lit(0)) == F.coalesce("pairs", F.lit(0))).alias("same_set"))


def require_dim(fact: DataFrame, dim: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a dimension row, and rows without one (UNKNOWN)."""
    d = dim.select(*keys).distinct()
    return fact.join(d, list(keys), "left_semi"), fact.join(d, list(keys), "left_anti")


def shrink_guard(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Sources whose fetched count is zero or under half of the last success."""
    j = current.join(previous.select(key, F.col("fetched").alias("previous")), key, "left")
    return j.withColumn("outcome", F.when(F.col("fetched") == 0, "EMPTY")
                        .when(F.col("fetched") * 2 < F.col("previous"), "SHRUNK").otherwise("OK"))


def canonical_names(df: DataFrame, code: str, name: str, year: str, order: str) -> DataFrame:
    """Newest year's name per code (later row wins ties), number of names, conflict flag."""
    named = F.when(F.col(name) != "", F.struct(F.coalesce(year, F.lit(0)).alias("y"), F.col(order).alias("o"),
                                               F.col(name).alias("v")))
    per_name = df.groupBy(code, name).agg(F.max(named).alias("_newest"))
    return per_name.groupBy(code).agg(
        F.coalesce(F.max("_newest")["v"], F.col(code)).alias("canonical_name"),
        F.count(F.lit(1)).alias("name_count")).withColumn("conflict", F.col("name_count") > 1)


def observed_names(dim: DataFrame, fact: DataFrame, keys: Sequence[str], dim_name: str, fact_name: str,
                   order: str) -> DataFrame:
    """First name seen in the facts that differs from the dimension's, with the number of names."""
    seen = fact.groupBy(*keys, fact_name).agg(F.min(order).alias("_o"))
    j = dim.select(*keys, dim_name).join(seen, list(keys))
    differs = F.col(fact_name) != F.col(dim_name)
    return j.groupBy(*keys, dim_name).agg(
        F.min_by(fact_name, F.when(differs, F.col("_o"))).alias("_first"),
        F.count(F.lit(1)).alias("names_seen"), F.max(differs.cast("int")).alias("_d")
    ).where("_d = 1").select(*keys, dim_name, F.col("_first").alias("observed_name"), "names_seen")


def ambiguous_codes(dim: DataFrame, code: str, kind: str) -> DataFrame:
    """Codes that occur under several kinds; kinds are an enum, so the list is short."""
    return (dim.select(code, kind).distinct().groupBy(code)
               .agg(F.count(F.lit(1)).alias("kinds_count"), F.array_sort(F.collect_list(kind)).alias("kinds"))
               .where("kinds_count > 1"))


def table_profile(df: DataFrame, keys: Sequence[str], area: str, period: str, amounts: Sequence[str]) -> DataFrame:
    """Shape of a table in one read: an aggregate over rows per key, then one over keys in which Spark counts the
    distinct areas and periods as grouping sets of the same pass."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("bigint") for c in df.columns])
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    neg = reduce(lambda a, b: a + b, [F.coalesce((F.col(c) < 0).cast("bigint"), F.lit(0)) for c in amounts])
    zero = reduce(lambda a, b: a + b, [F.coalesce((F.col(c) == 0).cast("bigint"), F.lit(0)) for c in amounts])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(nulls).alias("_nulls"),
                                    F.sum(neg).alias("_neg"), F.sum(zero).alias("_zero"),
                                    F.max(no_key.cast("int")).alias("_nokey"))
    return per_key.agg(
        F.sum("_n").alias("row_count"), F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1).otherwise(0)).alias("duplicate_keys"),
        F.sum(F.when(F.col("_nokey") == 1, F.col("_n")).otherwise(0)).alias("missing_key_rows"),
        F.sum("_nulls").alias("null_cells"), F.sum("_neg").alias("negative_amounts"), F.sum("_zero").alias("zero_amounts"),
        F.count_distinct(area).alias("areas"), F.count_distinct(period).alias("periods"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"))
