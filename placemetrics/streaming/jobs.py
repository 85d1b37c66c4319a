"""Incremental landing of panel files and the source freshness monitor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placemetrics.functions.hashing import multiset_fingerprint
from placemetrics.sources.release import Store

FRESH_DAYS = 3


def content_key(df: DataFrame, prefix: str = "r") -> str:
    """Release key out of the rows themselves: the same content gives the same key."""
    row = multiset_fingerprint(df, sorted(df.columns)).first()
    return f"{prefix}-{row['fingerprint'] if row else 'empty'}"


def stream_panel(landing: DataFrame, store: Store, checkpoint: str, validate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Publish, for every micro-batch of landed rows, a release of all rows landed so far.

    Each batch is written as one part; the rows before it are neither read nor written again. A row
    names its increment, the content key of its batch. A batch that is replayed, or files landed
    twice, are an increment that was appended before, and are dropped; so the sink is effectively once.
    """
    def publish(batch: DataFrame, _: int) -> None:
        rows = validate(batch).persist()
        try:
            if not rows.isEmpty():
                store.append(rows, content_key(rows, "i"))
        finally:
            rows.unpersist()

    return landing.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_success(events: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """Newest success per source; works on a stream (update or complete mode) and in batch."""
    return events.groupBy(source).agg(F.max(ts).alias("last_succeeded_at"))


def stream_last_success(events: DataFrame, target: str, checkpoint: str, source: str = "source", ts: str = "ts") -> StreamingQuery:
    """Keep the newest success per source of all events landed so far, as one small folder per micro-batch.

    The state is one row per source. A batch that is run again overwrites its own folder; readers take
    the newest (`newest_batch`).
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (last_success(events, source, ts).writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def newest_batch(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the newest batch below a folder; batches are committed whole."""
    batches = spark.read.parquet(target)
    return batches.join(F.broadcast(batches.agg(F.max("batch").alias("batch"))), "batch").drop("batch")     # one row


def source_freshness(last: DataFrame, as_of, days: int = FRESH_DAYS) -> DataFrame:
    """Fresh while the last success is at most ``days`` before the as-of day."""
    day = F.to_date("last_succeeded_at")
    return last.withColumns({"last_succeeded_on": day, "fresh": F.coalesce(F.date_add(day, days) >= as_of, F.lit(False))})
