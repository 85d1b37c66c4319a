"""Throttle audit: windows anchored at the first event of a key.

A window opens at an event and lasts ``window_ms``; the first event at or after its end opens
the next one. Which events are anchors depends on the anchors before, so it looks sequential.
Two facts make it a set of joins: a stretch of time of one window's length holds at most one
anchor, and an event after a silence of at least a window is always one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.session import cut


def millis(ts: Column) -> Column:
    """Whole milliseconds since 1970 on the clock of the column, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def anchors(times: DataFrame, key: str, window_ms: int) -> DataFrame:
    """Anchor times per key by pointer doubling: log2 of the longest dense run in joins.

    ``times``: distinct (key, t). The slot of an event is ``t div window``; the next anchor
    after an event lies in the next slot at the same offset or later, or is the first event of
    the next slot in use. Slots hold at most ``window_ms`` distinct times, whatever the key.
    """
    e = times.withColumn("slot", F.floor(F.col("t") / window_ms))
    slots = e.groupBy(key, "slot").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    by_slot = Window.partitionBy(key).orderBy("slot")
    # first event at or after the start of slot s + 2, for every slot s in use
    later = slots.select(key, "slot", "first_t", F.lag("last_t").over(by_slot).alias("prev_last"),
                         F.lead("slot", 1).over(by_slot).alias("n1"), F.lead("first_t", 1).over(by_slot).alias("f1"),
                         F.lead("first_t", 2).over(by_slot).alias("f2"))
    after = F.when(F.col("n1") > F.col("slot") + 1, F.col("f1")).otherwise(F.col("f2"))
    fallback = later.select(key, "slot", after.alias("after_t"))
    starts = later.where(F.col("prev_last").isNull() | (F.col("first_t") - F.col("prev_last") >= window_ms)).select(key, F.col("first_t").alias("t"))
    # probes of slot s are looked up among the events of slot s + 1, one window further on
    probe = e.select(key, (F.col("slot") + 1).alias("slot"), (F.col("t") + window_ms).alias("at"), F.lit(0).alias("is_event"), "t")
    event = e.select(key, "slot", F.col("t").alias("at"), F.lit(1).alias("is_event"), "t")
    w = Window.partitionBy(key, "slot").orderBy("at", "is_event").rowsBetween(0, Window.unboundedFollowing)
    seen = probe.unionByName(event).withColumn("near_t", F.min(F.when(F.col("is_event") == 1, F.col("t"))).over(w)).where("is_event = 0")
    nxt = (seen.withColumn("slot", F.col("slot") - 1).join(fallback, [key, "slot"])
               .select(key, "t", F.coalesce("near_t", "after_t").alias("to_t")).where("to_t IS NOT NULL"))
    # jumps into a start are not needed: starts are known anchors already
    jump = cut(nxt.join(starts.select(key, F.col("t").alias("to_t")), [key, "to_t"], "left_anti"))
    found = cut(starts)
    while not jump.isEmpty():
        reached = found.join(jump, [key, "t"]).select(key, F.col("to_t").alias("t"))
        found = cut(found.unionByName(reached).distinct())
        ahead = jump.select(key, F.col("t").alias("to_t"), F.col("to_t").alias("far_t"))
        jump = cut(jump.join(ahead, [key, "to_t"]).select(key, "t", F.col("far_t").alias("to_t")))
    return found


def throttle_audit(events: DataFrame, limit: int, window_ms: int, key: str = "user_id", event_id: str = "event_id", ts: str = "ts") -> DataFrame:
    """Window start, allowed flag and retry-after seconds of every event, in batch."""
    e = events.select(key, event_id, millis(F.col(ts)).alias("t")).withColumn("slot", F.floor(F.col("t") / window_ms))
    a = anchors(e.select(key, "t").distinct(), key, window_ms).withColumn("slot", F.floor(F.col("t") / window_ms))
    # at most one anchor per slot: the window of an event starts in its slot or at the last anchor before
    slots = e.select(key, "slot").distinct().join(a.select(key, "slot", F.col("t").alias("a_t")), [key, "slot"], "left")
    before = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("b_t", F.max("a_t").over(before))
    placed = e.join(slots, [key, "slot"]).withColumn("start_t", F.when(F.col("a_t") <= F.col("t"), F.col("a_t")).otherwise(F.col("b_t")))
    # the limit-th event of a window is a bounded top-n; everything after it is denied
    order = Window.partitionBy(key, "start_t").orderBy("t", event_id)
    first_n = placed.select(key, "start_t", "t", event_id).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit)
    last = first_n.where(F.col("_rn") == limit).select(key, "start_t", F.struct("t", event_id).alias("_last"))
    j = placed.join(last, [key, "start_t"], "left")
    allowed = F.col("_last").isNull() | (F.struct("t", event_id) <= F.col("_last"))
    wait = F.greatest(F.lit(1), F.ceil((F.col("start_t") + window_ms - F.col("t")) / 1000)).cast("bigint")
    return j.select(key, event_id, "start_t", allowed.alias("allowed"), F.when(~allowed, wait).alias("retry_after"))


OUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("start_t", T.LongType()),
                    T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.LongType())])
STATE = T.StructType([T.StructField("start_t", T.LongType()), T.StructField("count", T.LongType())])


def throttle_stream(events: DataFrame, limit: int, window_ms: int, delay: str = "10 minutes") -> DataFrame:
    """The same audit on a stream: per user the open window and its count are the state.

    Events of one trigger are taken in event-time order; events older than the watermark are
    dropped by Spark. State of a silent user times out one window after its last one.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"])
        rows = []
        for event, t in zip(pdf["event_id"], pdf["t"]):
            if start is None or start + window_ms <= t:
                start, count = int(t), 0
            count += 1
            ok = count <= limit
            rows.append((key[0], int(event), start, ok, None if ok else max(1, -(-(start + window_ms - int(t)) // 1000))))
        state.update((start, min(count, limit)))
        # a window past its end holds nothing that matters; the timeout may only lie ahead of the watermark
        state.setTimeoutTimestamp(max(start + window_ms, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(rows, columns=[f.name for f in OUT.fields])
        out["retry_after"] = out["retry_after"].astype("Int64")
        yield out

    # times on the clock of the watermark, which the state timeout is compared with
    instant = F.col("ts").cast("timestamp")
    timed = events.select("user_id", "event_id", instant.alias("ts"), F.unix_millis(instant).alias("t"))
    e = timed.withWatermark("ts", delay)
    return e.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")
