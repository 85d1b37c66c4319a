"""Embedding near-duplicates by NN-descent.

Every vector keeps a list of its nearest neighbours. A round sends each vector's list, and who lists
it, to one place, compares these neighbours' neighbours with one another, and keeps the best; pairs
whose entries both took part in an earlier round are passed over. Rounds end when few lists change. Then:

- lists full of links (cosine of the threshold or more) are saturated: the lists of all members of
  such a vector's component are enlarged to the whole component, compared in slices;
- recall is audited on a sample against all vectors; a link counts as found that the lists hold
  or that such an enlarged component of the lists holds. The sample grows until `LINKED` of its vectors have
  links, or until it is the whole table: a sample without links says nothing. As long as recall is under
  `RECALL` the rounds go on with longer lists and fresh random neighbours;
- if it still is after `ENLARGE` turns, or if the largest sample sent to tasks (`AUDIT_MOST`) holds fewer linked
  vectors, so that recall cannot be measured, all vectors are compared with all others in blocks, which is exact.

The recall of every turn is logged, that of the last returned.

Neighbours are sought with half-precision copies of the vectors; a link is only what double precision
confirms. Equal vectors form one point with a weight, so copies cost nothing.

Vectors that are null, zero, of another length than most, or hold null or non-finite components link
with nothing, as do rows with a null id (their component is null). Ties keep the smaller id. Repeated
rows are further vectors: each counts the others as links. Extra columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placemetrics.llm.components import components
from placemetrics.session import cut

THRESHOLD = 0.9
LIST = 12
START_BLOCK = 64
START_CHUNK = 2_000
STARTS = 6
ROUNDS = 5
AUDIT = 256
#: Largest sample, 16 MB of 128 components in double precision.
AUDIT_MOST = 16_384
#: Vectors with links that a sample needs to tell recall.
LINKED = 64
RECALL = 0.995
ENLARGE = 3
SLICE = 1_000
#: Half precision may miss a link by less than this.
SLACK = 0.01


def whole(parts: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by a column, cut so that no group is divided."""
    rest = None
    for part in parts:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if not len(part):
            continue
        key = part[by].to_numpy()
        start = int(np.searchsorted(key, key[-1]))
        if start:
            yield part.iloc[:start].reset_index(drop=True)
        rest = part.iloc[start:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def matrix(rows: pd.Series, kind: str = "<f2") -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float32 if kind == "<f2" else np.float64)


def points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (point, weight, exact, half) and which row has which (vec_id, embedding, point)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    # The usual length is the commonest one.
    usual = rows.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    size = usual[0]["d"] if usual else 0
    good = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == size)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    usable = rows.where(good)
    grouped = usable.groupBy("embedding").agg(F.min("vec_id").alias("point"), F.count("*").alias("weight"))

    def unit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.array(part["embedding"].tolist(), np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            yield pd.DataFrame({"point": part["point"], "weight": part["weight"], "exact": [v.tobytes() for v in x], "half": [v.astype("<f2").tobytes() for v in x]})

    found = cut(grouped.select("embedding", "point", "weight").mapInPandas(unit, "point long, weight long, exact binary, half binary"))
    return found, usable.join(grouped.select("embedding", "point"), "embedding").select("vec_id", "point")


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each list; an edge known before is not new."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def start(found: DataFrame, n: int, size: int, k: int, seeds: list[int]) -> DataFrame:
    """First lists from a forest of random splits: vectors on the same sides of a few planes lie together,
    chunks of them are halved along random directions, and the vectors of a leaf are compared."""
    planes = max(1, int(np.ceil(np.log2(max(2, n / START_CHUNK)))))

    def leaves(x: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
        if len(at) <= START_BLOCK:
            yield at
            return
        along = x[at] @ rng.normal(size=size).astype(np.float32)
        order = np.argpartition(along, len(at) // 2)
        yield from leaves(x, at[order[:len(at) // 2]], rng)
        yield from leaves(x, at[order[len(at) // 2:]], rng)

    directions = [np.random.default_rng(seed).normal(size=(size, planes + 1)).astype(np.float32) for seed in seeds]

    def sides(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = matrix(part["half"])
                for tree, across in enumerate(directions):
                    y = x @ across
                    yield part.assign(code=(y[:, 1:] > 0) @ (1 << np.arange(planes, dtype=np.int64)) + (tree << planes), along=y[:, 0].astype(np.float64))

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seeds[0])
        for part in whole(parts, "code"):
            for _, group in part.groupby("code", sort=False):
                for first in range(0, len(group), 2 * START_CHUNK):
                    own = group.iloc[first:first + 2 * START_CHUNK]
                    names, x = own["point"].to_numpy(), matrix(own["half"])
                    for leaf in leaves(x, np.arange(len(own)), rng):
                        yield edges_of(names[leaf], x[leaf], k)

    # All trees of the forest are dealt at once: one shuffle by tree, sides and direction.
    dealt = found.select("point", "half").mapInPandas(sides, "point long, half binary, code long, along double")
    return dealt.repartitionByRange("code", "along").sortWithinPartitions("code", "along").mapInPandas(blocks, "u long, v long, sim float, new boolean")


def edges_of(names: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each vector of one block."""
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(names) - 1)
    if k < 1:
        return pd.DataFrame({"u": [], "v": [], "sim": [], "new": []}).astype({"u": "int64", "v": "int64", "sim": "float32", "new": bool})
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return pd.DataFrame({"u": np.repeat(names, k), "v": names[top].ravel(), "sim": np.take_along_axis(sim, top, 1).ravel(), "new": True})


def chosen_readers(graph: DataFrame, k: int) -> DataFrame:
    """at, member, new: of those that list a vector as many as it lists itself, the new ones first, in a fixed random order."""
    readers = graph.select(F.col("v").alias("at"), F.col("u").alias("member"), "new")
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("new"), F.xxhash64("at", "member")))
    return readers.withColumn("place", place).where(F.col("place") <= k).drop("place")


def settled(graph: DataFrame, k: int) -> DataFrame:
    """The lists after a comparison: an entry is old only if its reader was among those chosen; the others wait, still new."""
    took = chosen_readers(graph, k).select(F.col("member").alias("u"), F.col("at").alias("v"), F.lit(True).alias("took"))
    return graph.join(took, ["u", "v"], "left").select("u", "v", "sim", (F.col("new") & F.col("took").isNull()).alias("new"))


def compare(graph: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Better neighbours found by comparing the members of each list, and of each list's readers, with one another."""
    forward = graph.select(F.col("u").alias("at"), F.col("v").alias("member"), "new")
    members = forward.unionByName(chosen_readers(graph, k)).groupBy("at", "member").agg(F.max("new").alias("new"))
    fresh = members.groupBy("at").agg(F.max("new").alias("any")).where("any").select("at")
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    known = found.select(F.col("point").alias("member"), "half").join(worst.select(F.col("u").alias("member"), F.when(F.col("n") >= k, F.col("worst")).otherwise(-2.0).cast("float").alias("worst")), "member", "left")
    sent = members.join(fresh, "at").join(known, "member").select("at", "member", "new", "half", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole(parts, "at"):
            at, member, new, worst_of = (part[c].to_numpy() for c in ("at", "member", "new", "worst"))
            x = matrix(part["half"])
            ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1
            out, first = [], 0
            for end in ends:
                s, first = slice(first, end), end
                own = x[s]
                sim = own @ own.T
                # Pairs of members both old were compared before; what is no better than the worst of a list is no use.
                use = (new[s][:, None] | new[s][None, :]) & (sim > worst_of[s][:, None])
                np.fill_diagonal(use, False)
                a, b = np.nonzero(use)
                if len(a):
                    out.append((member[s][a], member[s][b], sim[a, b]))
            if out:
                yield pd.DataFrame({"u": np.concatenate([o[0] for o in out]), "v": np.concatenate([o[1] for o in out]), "sim": np.concatenate([o[2] for o in out])}).drop_duplicates(["u", "v"]).assign(new=True)

    return sent.repartition("at").sortWithinPartitions("at").mapInPandas(run, "u long, v long, sim float, new boolean")


def descend(graph: DataFrame, found: DataFrame, k: int, n: int, rounds: int = ROUNDS) -> DataFrame:
    """Lists after rounds of comparing neighbours' neighbours."""
    for _ in range(rounds):
        graph = cut(best(settled(graph, k).unionByName(compare(graph, found, k)), k))
        if graph.where("new").count() < 0.05 * n * k:
            break
    return graph


def links_of(graph: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """a < b whose cosine in double precision reaches the threshold."""
    near = graph.where(F.col("sim") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    exact = near.join(found.select(F.col("point").alias("a"), F.col("exact").alias("x")), "a").join(found.select(F.col("point").alias("b"), F.col("exact").alias("y")), "b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.loc[np.einsum("ij,ij->i", matrix(part["x"], "<f8"), matrix(part["y"], "<f8")) >= threshold, ["a", "b"]]

    return cut(exact.mapInPandas(run, "a long, b long"))


def audit(found: DataFrame, threshold: float, most: int) -> DataFrame:
    """All true links of at most `most` sample vectors.

    The sample is sent to every task; each compares it with its vectors, a slice at a time.
    """
    spark = found.sparkSession
    sample = found.select("point", "exact").orderBy(F.xxhash64("point"), "point").limit(most).toPandas()
    shared = spark.sparkContext.broadcast((sample["point"].to_numpy(np.int64), matrix(sample["exact"], "<f8")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, x = shared.value
        for part in parts:
            for first in range(0, len(part), SLICE):
                rows = part.iloc[first:first + SLICE]
                other = rows["point"].to_numpy()
                i, j = np.nonzero(matrix(rows["exact"], "<f8") @ x.T >= threshold)
                use = other[i] != names[j]
                a, b = other[i][use], names[j][use]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sampled": b})

    return cut(found.select("point", "exact").mapInPandas(run, "a long, b long, sampled long"))


def telling_audit(found: DataFrame, threshold: float, n: int) -> DataFrame | None:
    """True links of the first sample, each four times the one before, in which `LINKED` vectors have links
    or that holds all `n`; None where the largest sample has fewer."""
    most = AUDIT
    while True:
        true = audit(found, threshold, most)
        if most >= n or true.select("sampled").distinct().count() >= LINKED:
            return cut(true.select("a", "b").distinct())
        if most >= AUDIT_MOST:
            return None
        most = min(4 * most, AUDIT_MOST)


def dense_members(links: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """point, component of all links; and of these the components that hold a saturated vector of `full`."""
    joined = cut(components(links).select(F.col("node").alias("point"), "component"))
    return joined, cut(joined.join(full, "point").select("component").distinct())


def recall_of(true: DataFrame, listed: DataFrame, full: DataFrame) -> float:
    """Share of the true links that the lists hold, or that enlarging finds: both ends in one dense component of the lists alone."""
    joined, dense = dense_members(listed, full)
    inside = joined.join(dense, "component")
    missed = true.join(listed, ["a", "b"], "left_anti")
    enlarged = missed.join(inside.select(F.col("point").alias("a"), "component"), "a").join(inside.select(F.col("point").alias("b"), "component"), ["b", "component"])
    total = true.count()
    return 1 - (missed.count() - enlarged.count()) / total if total else 1.0


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect all that a block of links connects."""
    rows, columns = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)  # not yet reached
    out: list[tuple[int, int]] = []
    for root in np.flatnonzero(near.any(axis=1)):
        if not rows[root]:
            continue
        rows[root], stack = False, [(int(root), True)]
        while stack:
            i, is_row = stack.pop()
            line, left = (near[i], columns) if is_row else (near[:, i], rows)
            fresh = np.flatnonzero(line & left)
            left[fresh] = False
            out += [(i, j) if is_row else (j, i) for j in fresh.tolist()]
            stack += [(j, not is_row) for j in fresh.tolist()]
    a = np.array(out, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def compared_in_blocks(found: DataFrame, member: DataFrame, threshold: float, connect: bool = False) -> DataFrame:
    """point, n_links (parts to be summed) of all members of the groups given (point, component), each compared with its whole
    group in slices; to `connect`, also rows with another point in `other`, which link all that is connected."""
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    rows = member.join(sizes, "component").join(found.select("point", "weight", "exact"), "point")
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("point"), slices).cast("int"))
    asks = rows.select("component", "point", "weight", "exact", F.lit(True).alias("asks"), F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("j"))
    gives = rows.select("component", "point", "weight", "exact", F.lit(False).alias("asks"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("i"))
    tasks = asks.unionByName(gives).withColumn("task", F.xxhash64("component", "i", "j"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole(parts, "task"):
            for _, group in part.groupby("task"):
                a, b = group[group["asks"]], group[~group["asks"]]
                if len(a) and len(b):
                    near = matrix(a["exact"], "<f8") @ matrix(b["exact"], "<f8").T >= threshold
                    near &= a["point"].to_numpy()[:, None] != b["point"].to_numpy()[None, :]
                    yield pd.DataFrame({"point": a["point"], "n_links": near @ b["weight"].to_numpy(), "other": None})
                    if connect and a["i"].iloc[0] <= a["j"].iloc[0]:
                        at, other = forest(near)
                        yield pd.DataFrame({"point": a["point"].to_numpy()[at], "n_links": 0, "other": b["point"].to_numpy()[other]})

    return tasks.repartition("task").sortWithinPartitions("task").mapInPandas(run, "point long, n_links long, other long")


def whole_component_counts(found: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """point, n_links of all members of the components given (point, component)."""
    return compared_in_blocks(found, member, threshold).groupBy("point").agg(F.sum("n_links").alias("n_links"))


def exact_counts(found: DataFrame, threshold: float) -> DataFrame:
    """point, n_links, component of every point by comparing all with all."""
    pairs = cut(compared_in_blocks(found, found.select("point", F.lit(0).alias("component")), threshold, connect=True))
    joined = components(pairs.where("other IS NOT NULL").select(F.col("point").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("point"), "component")
    sums = pairs.groupBy("point").agg(F.sum("n_links").alias("n_links"))
    return (found.select("point", "weight").join(sums, "point", "left").join(joined, "point", "left")
            .select("point", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("component")))


def counts_from_lists(found: DataFrame, listed: DataFrame, true: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """point, n_links, component of every point from the listed links, the audit's and the enlarged components."""
    # Only now do the audit's own links count as found.
    links = cut(listed.unionByName(true).distinct())
    joined, dense = dense_members(links, full)
    both = links.select(F.col("a").alias("point"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("point"), F.col("a").alias("other")))
    sparse = both.join(found.select(F.col("point").alias("other"), "weight"), "other").groupBy("point").agg(F.sum("weight").alias("n_links"))
    enlarged = whole_component_counts(found, joined.join(dense, "component"), threshold).withColumnRenamed("n_links", "n_whole")
    return (found.select("point", "weight").join(joined, "point", "left").join(sparse, "point", "left").join(enlarged, "point", "left")
              .select("point", (F.coalesce("n_whole", "n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("component")))


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, k: int = LIST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    return near_duplicates_and_recall(spark, vectors, threshold, k)[0]


def near_duplicates_and_recall(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, k: int = LIST) -> tuple[DataFrame, float]:
    """The rows of `near_duplicates`, and the audited recall of the lists they come from; 1 where all were compared."""
    found, rows = points(vectors)
    n = found.count()
    first = found.select("exact").first()
    graph, recall = None, 1.0
    true = telling_audit(found, threshold, n) if n > 1 else None
    if true is not None:
        size = len(first["exact"]) // 8
        for turn in range(ENLARGE):
            fresh = start(found, n, size, k, [1 + STARTS * turn + i for i in range(STARTS)])
            graph = descend(cut(best(fresh if graph is None else graph.withColumn("new", F.lit(True)).unionByName(fresh), k)), found, k, n)
            listed = links_of(graph, found, threshold)
            full = cut(graph.where(F.col("sim") >= threshold - SLACK).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("u").alias("point")))
            recall = recall_of(true, listed, full)
            logging.getLogger(__name__).info("turn %d: audited recall %.5f with lists of %d", turn + 1, recall, k)
            if recall >= RECALL:
                break
            k *= 2
    if n <= 1:
        counts = found.select("point", (F.col("weight") - 1).alias("n_links"), F.col("point").alias("component"))
    elif true is not None and recall >= RECALL:
        counts = counts_from_lists(found, listed, true, full, threshold)
    else:
        counts, recall = exact_counts(found, threshold), 1.0
    named = rows.join(counts, "point").select("vec_id", "n_links", "component")
    good = named.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component_id"))
    out = vectors.select("vec_id").join(good, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), recall
