"""Whitening of embeddings by a bit-sliced scatter matrix.

Entries become whole numbers, z = floor(64 * c) (x = z + 1000000 has the same covariance). A task
shifts each dimension of a batch by its least value, so that few bits are left, packs every bit plane
across the rows into 64-bit words and takes AND-popcounts of all pairs of planes. Weighted by their
powers of two they are the exact sums of cross-products; a plane of ones, one for every row, gives the
sums of the dimensions and the number of rows in the same way. Sums of tasks are added by Spark as
limbs of 48 bits, so they stay exact for any width and any number of rows. Only the d x d totals reach
the driver, which centres them as integers (n * sum xy - sum x * sum y) and takes eigenvectors.

The dimension is the most frequent length of the vectors (of equally frequent ones the larger).
Vectors that are null, hold null or non-finite entries, or are of another length are left out.
Entries with |64 * c| over 2^61 count as 2^61. Repeated rows count each. Rows with a null vec_id are
whitened too. Components without variance (eigenvalue not above the rounding of the largest) have no
whitened form and are not returned, so one single or many equal vectors, as an empty table, give no
rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm.words import pieces, thrifty

SCALE = 64
ORIGIN = 1_000_000
MOST = 2.0 ** 61
COMPONENTS = 32
LIMB = 48
ROWS = 4_096
#: Rows at a time when every row gives many.
OUT_ROWS = 512


@dataclass(frozen=True)
class Whitener:
    n: int
    sums: list[int]  # of x, one for each dimension
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # their unit eigenvectors, one in each column
    trace: float

    @property
    def kept(self) -> int:
        return len(self.values)


def usable(part: pa.RecordBatch, size: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole numbers z of the rows with a whole and finite vector of `size` entries; ids are never turned into floats."""
    ids, vectors = part.column(0), part.column(1)
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(lengths == size)
    flat = vectors.take(pa.array(fit)).flatten().cast(pa.float64())
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(fit), size)
    whole = np.isfinite(x).all(axis=1)
    z = np.floor(np.clip(SCALE * x[whole], -MOST, MOST)).astype(np.int64)
    return ids.take(pa.array(fit[whole])), z


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of whole numbers >= 0 (rows x dimensions) as 64-bit words across the rows: words, dimension and bit of each plane.

    The last plane has a one for every row, under the dimension after the last.
    """
    rows, size = y.shape
    words, dims, bits = [], [], []
    most = y.max(axis=0)
    for bit in range(int(most.max()).bit_length()):
        used = np.flatnonzero(most >> np.uint64(bit))
        words.append(np.packbits(((y[:, used] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=0).T)
        dims.append(used)
        bits.append(np.full(len(used), bit))
    words.append(np.packbits(np.ones((rows, 1), np.uint8), axis=0).T)
    dims.append(np.array([size]))
    bits.append(np.array([0]))
    packed = np.concatenate(words)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(packed).view(np.uint64), np.concatenate(dims), np.concatenate(bits)


def scatter(z: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of dimensions and a dimension of ones: (d + 1) x (d + 1) Python integers."""
    rows, size = z.shape
    low = z.min(axis=0)
    words, dims, bits = planes((z - low).view(np.uint64))
    counts = np.zeros((len(words), len(words)), np.int64)
    for k in range(len(words)):
        counts[k, k:] = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)
    counts += np.triu(counts, 1).T
    # Small widths are weighted in 64 bits, wide ones in Python's integers.
    kind = np.int64 if 2 * int(bits.max()) + rows.bit_length() + 14 < 62 else object
    weights = np.zeros((size + 1, len(words)), kind)
    weights[dims, np.arange(len(words))] = [1 << int(b) for b in bits]
    shifted = ((weights @ counts.astype(kind)) @ weights.T).astype(object)
    back = np.append(low, 0).astype(object)
    sums = shifted[:, size]
    return shifted + np.outer(back, sums) + np.outer(sums, back) + rows * np.outer(back, back)


def _dimension(vectors: DataFrame, column: str) -> int:
    size = F.size(column)
    top = vectors.where(size > 0).groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return int(top["size"]) if top else 0


def _added(tables: DataFrame) -> dict[tuple[int, int], int]:
    """Whole sums of the tasks' limbs by cell; d x d cells at most."""
    out: dict[tuple[int, int], int] = {}
    for r in tables.groupBy("a", "b", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        out[r.a, r.b] = out.get((r.a, r.b), 0) + (int(r.value) << (LIMB * r.limb))
    return out


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[Whitener | None, int]:
    """The whitening of all usable vectors, and their dimension; None where no component has variance."""
    size = _dimension(vectors, column)
    if not size:
        return None, 0

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in pieces(parts, ROWS):
            _, z = usable(part, size)
            if len(z):
                total = scatter(z) if total is None else total + scatter(z)
        rows = []
        for a in range(size + 1 if total is not None else 0):
            for b in range(a, size + 1):
                value, limb = int(total[a, b]), 0
                while value not in (0, -1):  # the highest limb carries the sign
                    rows.append((a, b, limb, value & ((1 << LIMB) - 1)))
                    value, limb = value >> LIMB, limb + 1
                rows.append((a, b, limb, value))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["a", "b", "limb", "value"])

    found = _added(vectors.select(F.lit(None).cast("long").alias("id"), column).mapInArrow(thrifty(run), "a int, b int, limb int, value long"))
    n = found.get((size, size), 0)
    if not n:
        return None, size
    sums = [found[a, size] for a in range(size)]
    # Centred as integers: n^2 times the covariance, then one rounded division for each cell.
    cov = np.array([[(n * found[min(a, b), max(a, b)] - sums[a] * sums[b]) / (n * n) for b in range(size)] for a in range(size)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, int((values > size * np.finfo(float).eps * max(values[0], 0)).sum()))
    trace = float(sum(n * found[a, a] - sums[a] ** 2 for a in range(size)) / (n * n))
    if not kept:
        return None, size
    return Whitener(n, [s + n * ORIGIN for s in sums], values[:kept].copy(), axes[:, :kept].copy(), trace), size


def _centred(model: Whitener, z: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: 64-bit where it fits, else Python's integers."""
    origin = np.array([s - model.n * ORIGIN for s in model.sums], object)
    most = max(int(np.abs(z).max(initial=0)) * model.n + max(abs(int(s)) for s in origin), 1)
    if most.bit_length() < 62:
        return z * model.n - origin.astype(np.int64)
    return z.astype(object) * model.n - origin


def _whitened(model: Whitener, centred: np.ndarray) -> np.ndarray:
    return (centred / model.n).astype(float) @ model.vectors / np.sqrt(model.values)


def _squares(centred: np.ndarray) -> list[int]:
    if centred.dtype != object and int(np.abs(centred).max(initial=0)).bit_length() * 2 + centred.shape[1].bit_length() < 62:
        return (centred * centred).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in centred]


def identity_error(vectors: DataFrame, model: Whitener, size: int, column: str = "embedding") -> float:
    """Largest entry of the covariance of the whitened rows themselves minus the identity."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((model.kept, model.kept)), np.zeros(model.kept)
        for part in pieces(parts, ROWS):
            _, z = usable(part, size)
            w = _whitened(model, _centred(model, z))
            products += w.T @ w
            sums += w.sum(axis=0)
        a, b = np.triu_indices(model.kept)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(a, np.arange(model.kept)), pa.int32()), pa.array(np.append(b, np.full(model.kept, -1)), pa.int32()),
                                          pa.array(np.append(products[a, b], sums))], ["a", "b", "value"])

    tables = vectors.select(F.lit(None).cast("long").alias("id"), column).mapInArrow(thrifty(run), "a int, b int, value double")
    found = {(r.a, r.b): r.value for r in tables.groupBy("a", "b").agg(F.sum("value").alias("value")).collect()}
    # Rows are centred exactly before they are projected, so the means are roundings, taken off all the same.
    means = [found[a, -1] / model.n for a in range(model.kept)]
    return max(abs(found[a, b] / model.n - means[a] * means[b] - (a == b)) for a in range(model.kept) for b in range(a, model.kept))


def whiten(spark: SparkSession, vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """`id_column`, component, n, deviation (exact, decimal), whitened, explained, identity_error for every usable row and component."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model, size = fit(vectors, column, components)
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(vectors, model, size, column)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = model.values / model.trace
        for part in pieces(parts, OUT_ROWS):
            ids, z = usable(part, size)
            if not len(z):
                continue
            centred = _centred(model, z)
            squares = _squares(centred)
            each = np.repeat(np.arange(len(z)), model.kept)
            deviation = pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0)) if max(squares).bit_length() < 63 else pa.array(squares, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, model.kept + 1, dtype=np.int32), len(z))),
                                              deviation.take(pa.array(each)), pa.array(_whitened(model, centred).ravel()),
                                              pa.array(np.tile(share, len(z)))], [id_column, "component", "deviation", "whitened", "explained"])

    rows = vectors.select(id_column, column).mapInArrow(thrifty(run), f"{id_column} {kind}, component int, deviation decimal(38,0), whitened double, explained double")
    return rows.select(id_column, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
