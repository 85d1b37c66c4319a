"""Word memo shared by the operators that work word by word inside a task.

Texts repeat their words, so a task computes what it needs once per distinct word, keeps it in
arrays, and gathers by word number. A memo holds a bounded number of words and starts afresh when
full, which costs time and changes no result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np

LIMIT = 300_000


class Memo(dict):
    """Word -> number in order of first sight; `fresh` gathers the words not yet computed."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, words: Iterable, count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, count)


class WordRows:
    """Rows of numbers per distinct word: `compute(words)` gives an array with a row for each."""

    def __init__(self, compute: Callable[[list], np.ndarray], limit: int = LIMIT) -> None:
        self.compute, self.limit = compute, limit
        self.memo, self.rows = Memo(), None

    def get(self, words: list) -> np.ndarray:
        """Row of every word of the list."""
        if len(self.memo) > self.limit:
            self.memo, self.rows = Memo(), None
        at = self.memo.numbers(words, len(words))
        if self.memo.fresh:
            new = self.compute(self.memo.fresh)
            self.memo.fresh = []
            have = len(self.memo) - len(new)
            if self.rows is None or len(self.rows) < len(self.memo):
                grown = np.zeros((max(1024, 2 * len(self.memo)), *new.shape[1:]), new.dtype)
                if have:
                    grown[:have] = self.rows[:have]
                self.rows = grown
            self.rows[have:have + len(new)] = new
        return self.rows[at] if self.rows is not None else self.compute([])


def batches(texts: list, weight: int = 1_000_000):
    """Slices of a list of texts with about so many characters each, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > weight:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (0 for an empty run), along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def give_back() -> None:
    """Hands memory that is free in this process back to the machine; without such a call of the C library, nothing."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What this worker process keeps from task to task, made at first use."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    """Forgets what tasks of another operator kept here, and hands its memory back."""
    if _kept:
        _kept.clear()
        give_back()


def thrifty(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """The task function, giving memory back as it ends: workers live on and would hold it through the next stages.

    Unless it uses what is `kept` itself, it also drops that as it starts.
    """
    @wraps(run)
    def wrapped(parts):
        if not keeps:
            drop_kept()
        try:
            yield from run(parts)
        finally:
            give_back()

    return wrapped


def pieces(parts: Iterable, rows: int = 1_000) -> Iterable:
    """The same Arrow batches cut into slices of so many rows, so that a task holds few texts twice."""
    for part in parts:
        for start in range(0, part.num_rows, rows):
            yield part.slice(start, rows)


def keep_rows(docs, decide: Callable[[], Callable[[list[str]], np.ndarray]]):
    """The rows of documents, all columns, whose text (null: empty) the decision made in each task keeps."""
    def run(parts):
        import pyarrow as pa
        keeps = decide()
        for part in pieces(parts):
            yield part.filter(pa.array(keeps([t or "" for t in part.column("text").to_pylist()]), pa.bool_()))

    return docs.mapInArrow(thrifty(run), docs.schema)


def map_frames(df, run: Callable[[Iterator], Iterator], schema: str, keeps: bool = False):
    """Like mapInPandas, but whole numbers stay whole where a column holds nulls too (nullable integers in place of doubles)."""
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = to_arrow_schema(StructType.fromDDL(schema))
    whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype()}

    def wrapped(parts):
        for out in run(part.to_pandas(types_mapper=whole.get) for part in parts):
            yield pa.RecordBatch.from_pandas(out, schema=kept, preserve_index=False)

    return df.mapInArrow(thrifty(wrapped, keeps), schema)
