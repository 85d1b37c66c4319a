"""Content addressing: canonical row text, row hashes and an order-free table fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_row(cols: Sequence[str]) -> Column:
    """One text per row. Nulls, separators and column order are unambiguous."""
    def cell(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(text.isNull(), F.lit("~")).otherwise(
            F.concat(F.length(text).cast("string"), F.lit(":"), text))
    return F.concat_ws("|", *[cell(c) for c in cols])


def row_hash(cols: Sequence[str]) -> Column:
    return F.sha2(canonical_row(cols), 256)


def _limb_sums(limbs: int = 8) -> list[Column]:
    """Sums of the eight 32-bit words of a SHA-256, mod 2^64 by wrap-free decimals."""
    out = []
    for i in range(limbs):
        word = F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
        out.append(F.sum(word * F.col("_n")).alias(f"_s{i}"))
    return out


def _row_sums(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The eight sums ``_s0`` ... of word hashes, and row_count."""
    counted = (df.select(*by, row_hash(cols).alias("_r"))
                 .groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_c")))
    mixed = counted.select(*by, F.sha2(F.concat_ws("x", "_r", F.col("_c").cast("string")), 256).alias("_h"),
                           F.lit(1).alias("_n"), "_c")
    return mixed.groupBy(*by).agg(*_limb_sums(), F.sum("_c").alias("row_count"))


def multiset_sums(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """row_count and the sums behind ``multiset_fingerprint``; those of tables without a common row add up."""
    sums = [F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("decimal(38,0)") for i in range(8)]
    return _row_sums(df, cols, by).select(*by, F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"), F.array(*sums).alias("sums"))


def fingerprint_of(sums: Sequence[int], row_count: int) -> str:
    """The fingerprint that ``multiset_fingerprint`` gives to a table with these sums."""
    return hashlib.sha256("/".join(map(str, [*sums, row_count])).encode()).hexdigest()


def multiset_fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fingerprint that is equal exactly for equal multisets of rows, in any order.

    Rows are reduced to (hash, copies); each pair is hashed again, so that copies count,
    and the eight 32-bit words of those hashes are *summed*. Sums combine on the map side:
    no global sort, no collected list, no group that has to fit in one task.
    """
    agg = _row_sums(df, cols, by)
    text = F.concat_ws("/", *[F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(8)],
                       F.coalesce(F.col("row_count"), F.lit(0)).cast("string"))
    return agg.select(*by, F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
                      F.sha2(text, 256).alias("fingerprint"))


def canonical_json(c: Column, dtype) -> Column:
    """JSON text with object keys sorted at every level.

    The sort happens on the *schema*, before any data is read: the struct is rebuilt with
    its fields in name order, maps become key-sorted maps, and ``to_json`` writes the result.
    """
    return F.to_json(_sorted_value(c, dtype), {"ignoreNullFields": "false"})


def _sorted_value(c: Column, dtype) -> Column:
    from pyspark.sql import types as T

    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        built = F.struct(*[_sorted_value(c[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(c.isNotNull(), built)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _sorted_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        return F.map_from_entries(F.transform(
            entries, lambda e: F.struct(e["key"], _sorted_value(e["value"], dtype.valueType))))
    return c
