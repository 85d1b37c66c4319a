"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _number(rows: DataFrame) -> Column:
    """The id as a long where it is a number, so that its hash does not hang on its width; text ids as they are."""
    return F.col("doc_id") if isinstance(rows.schema["doc_id"].dataType, StringType) else F.col("doc_id").cast("long")


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Columns of `labels` with `text`, for at most `most` labelled documents, chosen by a hash of the id.

    The chosen labels are broadcast: there are `most` of them at most. Of a repeated doc_id the
    least text is taken. Null ids and labels of no document are left out.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.min(c).alias(c) for c in labels.columns if c != "doc_id"))
              .orderBy(F.xxhash64(_number(labels)), "doc_id").limit(most))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.min(c).alias(c) for c in chosen.columns if c != "doc_id"))


def hashed_share(docs: DataFrame, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of id and text; all rows of a small table."""
    share = most / max(1, docs.count())
    if share >= 1:
        return docs
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).limit(2 * most)
