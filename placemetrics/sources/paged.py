"""Landed API responses: pages of JSON envelopes, positional rows, field-set drift, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.hashing import multiset_fingerprint

OK_CODE, EMPTY_CODE = "INFO-000", "INFO-200"


def parse_pages(pages: DataFrame, row_schema: str, body: str = "body") -> DataFrame:
    """Pages with ``code``, ``total`` and ``rows``; the envelope is read with a fixed schema.

    A body that is no JSON object gives code NOT_JSON.
    """
    env = F.from_json(body, f"total bigint, code string, row array<struct<{row_schema}>>", {"mode": "PERMISSIVE"})
    p = pages.withColumn("_e", env)
    code = F.when(F.col("_e").isNull() | (F.col("_e.code").isNull() & F.col("_e.total").isNull() & F.col("_e.row").isNull()), "NOT_JSON").otherwise(
        F.coalesce("_e.code", F.lit("NO_CODE")))
    return p.select(*[c for c in pages.columns if c != body], code.alias("code"), F.col("_e.total").alias("total"), F.col("_e.row").alias("rows"))


def page_checks(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per request: an error code, totals that differ between pages, or too few rows fail it."""
    good = F.col("code").isin(OK_CODE, EMPTY_CODE)
    n = F.when(F.col("code") == OK_CODE, F.coalesce(F.array_size("rows"), F.lit(0))).otherwise(0)
    total = F.when(F.col("code") == EMPTY_CODE, F.lit(0)).otherwise(F.col("total"))
    agg = parsed.groupBy(*keys).agg(
        F.min(F.when(~good, F.col("code"))).alias("error_code"), F.min(total).alias("_lo"), F.max(total).alias("_hi"),
        F.count(F.when(total.isNull() | (total < 0), 1)).alias("_no_total"), F.sum(n).alias("row_count"))
    outcome = (F.when(F.col("error_code").isNotNull(), "ERROR_CODE").when(F.col("_no_total") > 0, "NO_TOTAL")
               .when(F.col("_lo") != F.col("_hi"), "TOTAL_CHANGED").when(F.col("row_count") != F.col("_hi"), "INCOMPLETE").otherwise("OK"))
    return agg.select(*keys, "error_code", F.col("_hi").alias("total"), "row_count", outcome.alias("outcome"))


def read_paged_json(pages: DataFrame, row_schema: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of complete requests, and the check table of all requests."""
    parsed = parse_pages(pages, row_schema)
    checks = page_checks(parsed, keys)
    ok = checks.where("outcome = 'OK'").select(*keys)
    rows = parsed.join(ok, list(keys), "left_semi").select(*keys, F.explode("rows").alias("_r")).select(*keys, "_r.*")
    return rows, checks


def zip_columns(df: DataFrame, columns: str, items: str, names: Sequence[str]) -> DataFrame:
    """Array-shaped items whose names stand in a ``columns`` array -> one row per item."""
    row = df.withColumn("_item", F.explode(items))
    fit = F.slice(F.concat("_item", F.array_repeat(F.lit(None).cast("string"), F.size(columns))), 1, F.size(columns))
    m = row.withColumn("_m", F.map_from_arrays(F.col(columns), fit))
    return m.select(*[c for c in df.columns if c not in (columns, items)], *[F.try_element_at("_m", F.lit(n)).alias(n) for n in names])


def field_drift(df: DataFrame, body: str, expected: Sequence[str], order: str) -> DataFrame:
    """Rows per kind of drift: missing and unexpected fields, with the first row that shows it."""
    want = F.array(*[F.lit(e) for e in sorted(expected)])
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    d = df.select(F.array_join(F.array_except(want, keys), ",").alias("missing"), F.array_join(F.array_sort(F.array_except(keys, want)), ",").alias("unexpected"),
                  F.col(order).alias("_o"))
    return (d.where("missing <> '' OR unexpected <> ''").groupBy("missing", "unexpected")
             .agg(F.count(F.lit(1)).alias("row_count"), F.min("_o").alias("first_row")))


def source_manifest(df: DataFrame, role: str, part: str, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and fingerprint per role and part, and rolled up to one row per role."""
    parts = multiset_fingerprint(df, cols, by=[role, part])
    rolled = multiset_fingerprint(parts, [part, "fingerprint"], by=[role]).select(role, F.col("row_count").alias("parts"), "fingerprint")
    sizes = parts.groupBy(role).agg(F.sum("row_count").alias("row_count"))
    return parts, rolled.join(sizes, role)

