"""Delimited text with recorded header sets, and unions over source generations."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


class HeaderMismatch(ValueError):
    """The file's header set is not the recorded one."""


@dataclass(frozen=True)
class TableSchema:
    """Source column name -> canonical name, for one generation of a source."""

    columns: Mapping[str, str]
    encoding: str = "UTF-8"
    separator: str = ","


def check_header(found: Sequence[str], schema: TableSchema) -> None:
    """Reject duplicate, missing and extra column names."""
    names = [c.strip().lstrip("﻿") for c in found]
    duplicate = sorted({c for c in names if names.count(c) > 1})
    missing = [c for c in schema.columns if c not in names]
    extra = [c for c in names if c not in schema.columns]
    if duplicate or missing or extra:
        raise HeaderMismatch(f"duplicate {duplicate}, missing {missing}, unexpected {extra}")


def read_headers(spark: SparkSession, path: str, schema: TableSchema) -> dict[tuple[str, ...], list[str]]:
    """Header -> files that begin with it. Every file of the folder is asked for its own first line."""
    lines = (spark.read.option("header", "false").option("encoding", schema.encoding).option("sep", "\u0001").option("quote", "")
             .schema("line string").csv(path).select("line", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")))
    # a file's first split holds its first line, and row numbers ascend inside a split
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("line", "at").alias("line"))
    out: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file_path").collect():
        names = next(csv.reader([row["line"]], delimiter=schema.separator))
        out.setdefault(tuple(c.strip().lstrip("\ufeff") for c in names), []).append(row["file_path"])
    return out


def read_versioned(spark: SparkSession, path: str, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """Rows under canonical names, all text, and the rows of wrong width.

    The header of every file must be exactly the recorded set, in any order; files of one order are
    read together.
    """
    rows = bad = None
    for names, files in read_headers(spark, path, schema).items():
        check_header(names, schema)
        fields = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField(CORRUPT, T.StringType())])
        df = (spark.read.schema(fields).option("header", "true").option("encoding", schema.encoding)
              .option("sep", schema.separator).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              # a pruned parse would not see that a row is too wide
              .option("columnPruning", "false").option("enforceSchema", "true").csv(files))
        # the reader wants another column next to the corrupt-record one in every query
        broken = F.col(CORRUPT).isNotNull() | (F.length(names[0]) < 0)
        wide = df.where(broken).select(F.lit("ROW_WIDTH").alias("code"), F.col(CORRUPT).alias("detail"))
        good = df.where(F.col(CORRUPT).isNull()).select(*[F.col(src).alias(dst) for src, dst in schema.columns.items()])
        rows, bad = (good, wide) if rows is None else (rows.unionByName(good), bad.unionByName(wide))
    if rows is None:
        raise HeaderMismatch(f"no file with a header in {path}")
    return rows, bad


def union_years(parts: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """One table out of generations whose columns carry different names."""
    out = None
    for df, mapping in parts:
        missing = [c for c in mapping if c not in df.columns]
        if missing:
            raise HeaderMismatch(f"missing {missing}")
        one = df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])
        out = one if out is None else out.unionByName(one)
    return out
