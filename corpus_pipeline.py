"""Training-data pipeline over `documents`: toxic and poor documents go, one of each group of near
duplicates stays, secrets are blanked out, and the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
the documents. Models of the first two stages learn from `labels` and from the documents that reach
them. Extra columns pass through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm import jaccard_join, packing, quality, secret_scan, toxicity
from placemetrics.session import cut


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the ordinal model calls toxic. Null texts are not toxic."""
    return toxicity.clean(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under the quantile at the share of poor labels (0.3 at most)."""
    labels = _labels(spark, sf_dir)
    model = quality.train(docs, labels)
    low = labels.agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0] or 0.0
    return quality.good(docs, model, quality.keep_threshold(quality.score(docs, model), low))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of every group linked at a Jaccard similarity of 0.75 of five-word shingles."""
    return jaccard_join.one_of_each(spark, docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by [SECRET] and counts the characters of changed texts again."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack(spark, docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("secrets", blank_secrets), ("packing", pack_sequences)]

#: Learned models and tokenizers have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
