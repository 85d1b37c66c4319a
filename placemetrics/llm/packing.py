"""Best-fit packing of documents into sequences of at most `capacity` tokens.

Documents longer than the capacity are cut into full pieces and a rest. How pieces of each length
share sequences depends on the counts of the lengths alone, and there are at most `capacity`
lengths, so the plan is made from that small histogram and grows with the capacity, not the rows:

- large-item matching: lengths above a third of the capacity pair at most twice in a sequence, the
  longest first, each with the longest partner that fits;
- smaller lengths, longest first, go to the sequences with the smallest gap that holds them, and
  open new ones only when no gap does.

Each step of the plan sends a run of equally long pieces to a run of sequences. Pieces get their
place in the run by counts over hash buckets, so no length meets in one task.

Null texts are empty; an empty document still has its end token and so one piece. Repeated rows are
packed each for itself. Rows with a null doc_id are packed too. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placemetrics.llm.bpe import VOCABULARY, encoder
from placemetrics.llm.words import batches, thrifty
from placemetrics.llm.words import pieces as slices
from placemetrics.session import cut

CAPACITY = 2048
END_ID = 0
ROWS_PER_BUCKET = 5_000
#: Words a task remembers here.
MEMO = 220_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, limit=MEMO)
        for part in slices(parts):
            texts, names = [t or "" for t in part.column("text").to_pylist()], part.column("doc_id")
            for s in batches(texts):
                ids, counts = enc.texts(texts[s])
                rows, at = [], 0
                for k, n in enumerate(counts):
                    own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        x = own[start:start + capacity]
                        rows.append((s.start + k, piece, start, len(x), zlib.crc32(x.tobytes())))
                k, *columns = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(k)), *map(pa.array, columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(thrifty(run, keeps=True), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first, n, sequence, offset, per): the n pieces of this length whose rank starts
    at `first` go, `per` to each, to sequences from `sequence` on, from `offset` on."""
    left = {k: v for k, v in counts.items() if v > 0}
    used: dict[int, int] = {}
    steps: list[tuple[int, int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    new = 0

    def place(length: int, n: int, sequence: int, offset: int, per: int = 1) -> None:
        steps.append((length, used.get(length, 0), n * per, sequence, offset, per))
        used[length] = used.get(length, 0) + n * per
        left[length] -= n * per

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            open_at.setdefault(gap, []).append((sequence, n))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= capacity - a and left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            place(a, n, new, 0)
            if b is not None:
                place(b, n, new, a)
            leave(capacity - a - (b or 0), new, n)
            new += n
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            gap = min((g for g in open_at if g >= x), default=None)
            if gap is None:
                per = capacity // x
                if n := left[x] // per:
                    place(x, n, new, 0, per)
                    leave(capacity - per * x, new, n)
                    new += n
                if rest := left[x]:
                    place(x, 1, new, 0, rest)
                    leave(capacity - rest * x, new, 1)
                    new += 1
                continue
            sequence, n = open_at[gap].pop()
            fill = min(n, left[x])
            if fill < n:
                open_at[gap].append((sequence + fill, n - fill))
            if not open_at[gap]:
                del open_at[gap]
            place(x, fill, sequence, capacity - gap)
            leave(gap - x, sequence, fill)
    return steps


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cut_up = cut(pieces(docs, capacity, vocabulary, end_id))
    # At most `capacity` rows reach the driver, whatever the table.
    counts = {int(r["length"]): int(r["n"]) for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = plan(counts, capacity)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // ROWS_PER_BUCKET)
    dealt = cut_up.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
    ranked = inside.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    # The steps of one length in order of rank: arrays in a table with one row per length, bounded by the capacity.
    by_length: dict[int, list] = {}
    for length, *step in sorted(steps):
        by_length.setdefault(length, []).append(tuple(step))
    table = spark.createDataFrame([(k, v) for k, v in by_length.items()],
                                  "length long, steps array<struct<first:long,n:long,sequence:long,at:long,per:long>>")
    table = table.select("length", F.explode("steps").alias("step")).select("length", "step.*")
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))).drop(table["length"])
    past = F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(past / F.col("per"))).alias("sequence_id"),
                         (F.col("at") + (past % F.col("per")) * F.col("length")).alias("offset"))
