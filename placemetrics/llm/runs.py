"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q and length >= max(least, repeats * q)
that no neighbouring word extends keeping the period. In such a run every word stands `repeats` times
at least. So a word that stands fewer times in its segment can be in no run there: it splits the
segment. Segments left are shorter, other words become rare in them, and splitting is repeated until
nothing changes; all texts of a batch are split at once. Segments that survive are scanned lag by lag:
a run of length repeats * q covers as many neighbouring multiples of q, so lag q asks only those
places for equal words and extends what it finds in growing blocks to both ends. Lags rise, so a
stretch already found under a smaller period is not taken again.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words and no runs. Repeated rows are
scanned each; rows with a null doc_id too. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.llm.words import Memo, batches, pieces, thrifty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
REPEATS = 4
LEAST = 6


def segments(ids: np.ndarray, owner: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [start, end) of places that frequency splitting leaves; `owner` numbers the text of each place, rising."""
    at = np.arange(len(ids))
    part = owner.astype(np.int64)
    while len(at):
        key = part * (int(ids.max()) + 1) + ids[at]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        often = np.empty(len(at), np.int64)
        often[order] = np.repeat(np.diff(np.append(first, len(at))), np.diff(np.append(first, len(at))))
        # Places next to each other in one text and one segment stay together.
        kept = often >= repeats
        left, left_part = at[kept], part[kept]
        begins = np.ones(len(left), bool)
        begins[1:] = (np.diff(left) != 1) | (left_part[1:] != left_part[:-1])
        number = np.cumsum(begins) - 1
        sizes = np.bincount(number) if len(left) else np.zeros(0, np.int64)
        long = sizes[number] >= least if len(left) else np.zeros(0, bool)
        stable = len(left) == len(at) and bool(long.all())
        at, part = left[long], number[long]
        if stable:
            break
    if not len(at):
        return []
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return [(int(at[s]), int(at[e - 1]) + 1) for s, e in zip(starts, np.append(starts[1:], len(at)), strict=True)]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two equally long arrays agree, looked at in growing blocks."""
    at, block = 0, 32
    while at < len(a):
        same = a[at:at + block] == b[at:at + block]
        if not same.all():
            return at + int(same.argmin())
        at, block = at + len(same), 2 * block
    return at


def scan(ids: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one segment, by start, then period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    by_period: dict[int, list[tuple[int, int]]] = {}
    for q in range(1, n // repeats + 1):
        marks = ids[::q]
        same = marks[1:] == marks[:-1]
        held = same[:len(same) - repeats + 2].copy()
        for k in range(1, repeats - 1):
            held &= same[k:len(same) - repeats + 2 + k]
        hits = np.flatnonzero(held) * q
        if not len(hits):
            continue
        reach = (repeats - 1) * q
        known = [r for p in by_period if q % p == 0 for r in by_period[p]]
        done = -1
        for a in hits.tolist():
            # A run of a period dividing q that holds all the places asked is the stretch itself.
            if a + reach < done or any(s <= a and a + reach < e for s, e in known):
                continue
            end = a + q + _agree(ids[a:n - q], ids[a + q:])
            start = a - _agree(ids[:a][::-1], ids[q:a + q][::-1])
            done = max(done, end)
            if end - start >= max(least, repeats * q) and (start, end) not in found:
                found[start, end] = q
                by_period.setdefault(q, []).append((start, end))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(texts: list[list[str]], repeats: int = REPEATS, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    memo, total = Memo(), int(sizes.sum())
    if not total:
        return out
    ids = memo.numbers((w for t in texts for w in t), total)
    owner, begins = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    for start, end in segments(ids, owner, repeats, least):
        k = int(owner[start])
        shift = start - int(begins[k])
        out[k] += [(shift + s, length, q) for s, length, q in scan(ids[start:end], repeats, least)]
    return out


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return " ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)


def find_runs(docs: DataFrame, repeats: int = REPEATS, least: int = LEAST, words_of: Callable[[object, str], list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and the collapsed text of every row.

    `words_of(doc_id, text)` may give other words than those of the text.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            texts = [t or "" for t in part.column("text").to_pylist()]
            names = part.column("doc_id")
            for s in batches(texts):
                own = names.slice(s.start, s.stop - s.start)
                words = [words_of(i, t) for i, t in zip(own.to_pylist(), texts[s], strict=True)] if words_of else [WORD.findall(t) for t in texts[s]]
                found = runs_of(words, repeats, least)
                listed = [[{"start": a, "length": b, "period": c} for a, b, c in rs] for rs in found]
                yield pa.RecordBatch.from_arrays([own, pa.array([len(w) for w in words], pa.int64()), pa.array(listed, run_type),
                                                  pa.array([collapse(w, rs) for w, rs in zip(words, found, strict=True)], pa.string())],
                                                 ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(thrifty(run), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"),
                    lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """The result of `find_runs` as numbers and digests: one row for each."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.select("*", strongest(F.col("runs")).alias("best"))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                       F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
