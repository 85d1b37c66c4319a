"""Exact n-gram Jaccard join by prefix trees.

1. A text's n-grams are hashed to 64 bits; texts with equal sets form one class (its copies).
2. N-grams of all classes are dealt by hash range, packed; each range counts in how many classes each
   n-gram stands. A class that shares too few n-grams with any other is out: a partner needs
   `similarity` of its set.
3. The global order of n-grams is by that count, so a class has few rare ones: two similar classes
   share one of the rarest `shared - needed + 1`. Classes that share such an n-gram fall into one
   block (components over one pair per n-gram and class, not all pairs).
4. A block is one prefix tree: sets in the global order, commonest n-grams first, so that alike sets
   share branches. Each set walks the tree, counts its overlap branch by branch, and leaves a subtree
   when what remains of it and of the set cannot reach the needed overlap, when its set sizes lie
   too far apart, or when all below already belongs to the set's component. Then it is added.
5. A block of more than `BLOCK` classes is first compared with one hub; classes not linked to it walk
   the trees of all slices of the block. So a large group of near copies costs a comparison each.

Links that only repeat a connection are not written; components lose none. A text of fewer than n
words is one n-gram of all its words; null or wordless texts have none and are linked with nothing.
Copies, ties and repeated rows share a class; a doc_id that stands on several rows has a result for
each. Null ids never become a component's name: a component without any id is null. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm.components import components
from placemetrics.llm.words import WordRows, batches, give_back, map_frames, thrifty
from placemetrics.session import cut

N = 5
PERCENT = 75
BLOCK = 1_000
PER_RANGE = 1_500_000
LOW48 = np.uint64((1 << 48) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashed n-grams of texts: ASCII letters lower-cased, words apart at ASCII white space."""

    def __init__(self, n: int = N) -> None:
        import xxhash
        self.n, self.hash = n, xxhash.xxh64_intdigest
        self.rows = WordRows(lambda words: np.array([self.hash(w) for w in words], np.uint64))

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        for s in batches(texts):
            split = [t.encode().lower().split() for t in texts[s]]
            flat = [w for ws in split for w in ws]
            word = self.rows.get(flat) if flat else np.zeros(0, np.uint64)
            gram = np.zeros(max(0, len(word) - self.n + 1), np.uint64)
            for i in range(self.n):
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + word[i:i + len(gram)]
            gram = _mixed(gram)
            at = 0
            for ws in split:
                if len(ws) >= self.n:
                    yield np.unique(gram[at:at + len(ws) - self.n + 1])
                else:
                    yield np.array([self.hash(b" ".join(ws), seed=len(ws))] if ws else [], np.uint64)
                at += len(ws)

    def class_of(self, grams: np.ndarray) -> int:
        return int(np.uint64(self.hash(grams.tobytes())).astype(np.int64))


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Least overlap of a set of n with any similar set."""
    return -(-percent * n // 100)


def profile(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, text_key (hash of the text, which tells rows of one id apart), n_shingles, class (null without n-grams)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for part in parts:
            sets = [(len(g), shingler.class_of(g) if len(g) else None) for g in shingler.sets(part["text"].fillna("").tolist())]
            out = pd.DataFrame({"doc_id": part["doc_id"], "text_key": part["text_key"], "n_shingles": [k for k, _ in sets]})
            yield out.assign(**{"class": pd.array([c for _, c in sets], dtype="Int64")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(docs.select("doc_id", "text", _text_key()), run, f"doc_id {kind}, text_key long, n_shingles long, class long")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _packed(docs: DataFrame, ranges: int, n: int) -> DataFrame:
    """Rows of (range, classes, counts, high, low): the n-grams of many classes in one hash range.

    With many ranges a class has few n-grams in each, so what stands there per class is kept small: its
    name, and a count of one byte where that is enough.
    """

    def flush(held: dict[int, np.ndarray]) -> pd.DataFrame:
        names, sets = np.fromiter(held, np.int64, len(held)), list(held.values())
        sizes = np.array([len(g) for g in sets], np.int64)
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        where = ((grams >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(where * len(sets) + owner, kind="stable")
        grams, owner, where = grams[order], owner[order], where[order]
        rows = []
        for r, cut_at in zip(*np.unique(where, return_index=True), strict=True):
            end = np.searchsorted(where, r, side="right")
            own, counts = np.unique(owner[cut_at:end], return_counts=True)
            g = grams[cut_at:end] & LOW48
            rows.append((int(r), names[own].tobytes(), counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes(),
                         (g >> np.uint64(32)).astype("<u2").tobytes(), g.astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["range", "classes", "counts", "high", "low"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        held, total = {}, 0
        for part in parts:
            for grams in shingler.sets(part["text"].fillna("").tolist()):
                name = shingler.class_of(grams) if len(grams) else None
                if name is not None and name not in held:
                    held[name] = grams
                    total += len(grams)
                if total > PER_RANGE:
                    yield flush(held)
                    held, total = {}, 0
        if held:
            yield flush(held)

    return docs.select("text").mapInPandas(thrifty(run), "range int, classes binary, counts binary, high binary, low binary")


def _numbers(rows: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def _shared(packed: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """N-grams of one range that stand in several classes, dealt to buckets of classes.

    A key has the count of classes, reversed, above the low bits of the hash: ascending keys are the global order.
    """
    columns = ["bucket", "classes", "counts", "keys"]
    names = _numbers(packed["classes"], "<i8")
    counts = np.concatenate([np.frombuffer(c, "<u1" if 8 * len(c) == len(k) else "<u4") for k, c in zip(packed["classes"], packed["counts"], strict=True)]).astype(np.int64)
    gram = (_numbers(packed["high"], "<u2").astype(np.uint64) << np.uint64(32)) | _numbers(packed["low"], "<u4")
    classes, first = np.unique(names, return_index=True)
    keep = np.zeros(len(names), bool)
    keep[first] = True  # copies in other batches
    gram = gram[np.repeat(keep, counts)]
    owner = np.repeat(np.searchsorted(classes, names[keep]), counts[keep])
    order = np.argsort(gram)
    gram, owner = gram[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    times = np.diff(np.append(starts, len(gram)))
    df = np.repeat(times, times)
    many = df > 1
    key = (np.uint64(0xFFFF) - np.minimum(df[many], 0xFFFF).astype(np.uint64) << np.uint64(48)) | gram[many]
    owner = owner[many]
    if not len(key):
        return pd.DataFrame(columns=columns)
    bucket = classes % buckets
    order = np.lexsort((owner, bucket[owner]))
    key, owner = key[order], owner[order]
    ends = np.flatnonzero(np.concatenate([bucket[owner][1:] != bucket[owner][:-1], [True]])) + 1
    rows, at = [], 0
    for end in ends:
        own, n = np.unique(owner[at:end], return_counts=True)
        rows.append((int(bucket[own[0]]), classes[own].tobytes(), n.astype("<i4").tobytes(), key[at:end].tobytes()))
        at = end
    return pd.DataFrame(rows, columns=columns)


def _survivors(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    """class, n, keys (sorted), rare (the rarest, one of which any partner shares) of classes that share enough.

    Rows with a `class` tell the sizes of the sets, the others hold n-grams.
    """
    told, part = part[part["class"].notna()], part[part["class"].isna()]
    sized = pd.DataFrame({"class": told["class"].astype(np.int64), "n": told["n"].astype(np.int64)}).sort_values("class")
    names, counts, keys = _numbers(part["classes"], "<i8"), _numbers(part["counts"], "<i4"), _numbers(part["keys"], "<u8")
    classes, owner = np.unique(names, return_inverse=True)
    owner = np.repeat(owner, counts)
    total = np.bincount(owner, minlength=len(classes))
    n = sized["n"].to_numpy()[np.searchsorted(sized["class"].to_numpy(), classes)]
    good = total >= needed(n, percent)
    keep = good[owner]
    keys, owner = keys[keep], owner[keep]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    rows, start = [], 0
    for c in np.flatnonzero(good):
        own = keys[start:start + total[c]]
        start += total[c]
        rows.append((classes[c], n[c], own.tobytes(), own[-(total[c] - needed(n[c], percent) + 1):].view(np.int64)))
    return pd.DataFrame(rows, columns=["class", "n", "keys", "rare"])


class Node:
    __slots__ = ("keys", "children", "ends", "least", "most", "rest", "some", "uniform")

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.children, self.ends = keys, {}, []
        self.least, self.most, self.rest, self.some, self.uniform = 1 << 60, 0, 0, -1, True


class PrefixTree:
    """Sets in the global order; `walk` finds the sets similar to one, `add` stores it."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.root, self.percent = Node(np.zeros(0, np.uint64)), percent
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def new(self, n: int, component: int | None = None) -> int:
        self.parent.append(len(self.parent) if component is None else component)
        self.sizes.append(n)
        return len(self.parent) - 1

    def alike(self, overlap: int, a: int, b: int) -> bool:
        return 100 * overlap >= self.percent * (a + b - overlap)

    def walk(self, number: int, keys: np.ndarray) -> list[int]:
        """Numbers of similar sets of other components; their components are merged as they are found."""
        n, found = self.sizes[number], []
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, pos = stack.pop()
            if node.uniform and node.some >= 0 and self.find(node.some) == self.find(number):
                continue
            if 100 * node.most < self.percent * n or self.percent * node.least > 100 * n:
                continue
            if not self.alike(overlap + min(len(keys) - pos, node.rest + len(node.keys)), n, node.least):
                continue
            if len(node.keys):
                at = np.searchsorted(keys, node.keys)
                overlap += int(np.count_nonzero(keys[np.minimum(at, len(keys) - 1)] == node.keys))
                pos = int(np.searchsorted(keys, node.keys[-1], side="right"))
                if not self.alike(overlap + min(len(keys) - pos, node.rest), n, node.least):
                    continue
            for other in node.ends:
                if self.find(other) != self.find(number) and self.alike(overlap, n, self.sizes[other]):
                    self.parent[self.find(other)] = self.find(number)
                    found.append(other)
            stack += [(child, overlap, pos) for child in node.children.values()]
        return found

    def _see(self, node: Node, number: int, rest: int) -> None:
        n = self.sizes[number]
        node.least, node.most, node.rest = min(node.least, n), max(node.most, n), max(node.rest, rest)
        node.uniform = node.uniform and (node.some < 0 or self.find(node.some) == self.find(number))
        node.some = number

    def add(self, number: int, keys: np.ndarray) -> None:
        node, at = self.root, 0
        self._see(node, number, len(keys))
        while at < len(keys):
            child = node.children.get(int(keys[at]))
            if child is None:
                child = Node(keys[at:])
                node.children[int(keys[at])] = child
                self._see(child, number, 0)
                child.ends.append(number)
                return
            own = keys[at:at + len(child.keys)]
            same = child.keys[:len(own)] == own
            common = len(own) if same.all() else int(same.argmin())
            if common < len(child.keys):
                upper = Node(child.keys[:common])
                upper.least, upper.most, upper.rest, upper.some, upper.uniform = child.least, child.most, child.rest + len(child.keys) - common, child.some, child.uniform
                child.keys = child.keys[common:]
                upper.children[int(child.keys[0])] = child
                node.children[int(keys[at])] = upper
                child = upper
            at += common
            node = child
            self._see(node, number, len(keys) - at)
        node.ends.append(number)


def tree_links(stored: pd.DataFrame, walking: pd.DataFrame | None, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) of one block: every stored set walks the tree before it is added; or, where `walking`
    is given, the stored sets are only added (those of one `known` component together) and the others walk."""
    tree, links = PrefixTree(percent), []
    names: list[int] = []
    known: dict[int, int] = {}
    sets = [np.frombuffer(k, "<u8") for k in stored["keys"]]
    for name, n, keys, group in zip(stored["class"], stored["n"], sets, stored["known"] if walking is not None else [None] * len(stored), strict=True):
        number = tree.new(int(n), known.get(group))
        if group is not None:
            known.setdefault(group, number)
        names.append(int(name))
        if walking is None:
            links += [(names[number], names[b]) for b in tree.walk(number, keys)]
        tree.add(number, keys)
    if walking is not None:
        have = {name: i for i, name in enumerate(names)}
        for name, n, keys in zip(walking["class"], walking["n"], walking["keys"], strict=True):
            number = have.get(int(name))
            if number is None:
                number = tree.new(int(n))
                names.append(int(name))
            links += [(names[number], names[b]) for b in tree.walk(number, np.frombuffer(keys, "<u8"))]
    return links


def _links(spark: SparkSession, sets: DataFrame, percent: int, block_size: int) -> DataFrame:
    """Links (a, b) between classes, enough to connect all that are connected."""
    rare = sets.select("class", F.explode("rare").alias("gram"))
    centre = rare.groupBy("gram").agg(F.min("class").alias("centre"))
    near = rare.join(centre, "gram").where("class <> centre").select(F.col("class").alias("a"), F.col("centre").alias("b"))
    block = components(near).select(F.col("node").alias("class"), F.col("component").alias("block"))
    sized = block.join(block.groupBy("block").agg(F.count("*").alias("size")), "block")
    known = cut(sets.drop("rare").join(sized, "class"))

    def small(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(parts, ["block"]):
            yield pd.DataFrame(tree_links(group, None, percent), columns=["a", "b"])

    links = known.where(F.col("size") <= block_size).repartition("block").sortWithinPartitions("block", "class").mapInPandas(thrifty(small), "a long, b long")

    large = known.where(F.col("size") > block_size)
    # The hub has the largest part of its n-grams in other classes: the text that others were made from.
    hub = large.groupBy("block").agg(F.max(F.struct(F.length("keys") / F.col("n"), "class", "n", "keys")).alias("hub"))
    compared = large.join(hub, "block")

    def to_hub(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = [np.frombuffer(k, "<u8") for k in part["keys"]]
            other = [np.frombuffer(h["keys"], "<u8") for h in part["hub"]]
            overlap = np.array([np.intersect1d(a, b, assume_unique=True).size for a, b in zip(own, other, strict=True)])
            union = part["n"].to_numpy() + np.array([h["n"] for h in part["hub"]]) - overlap
            yield part.drop(columns="hub").assign(hub=[h["class"] for h in part["hub"]], linked=100 * overlap >= percent * union)

    large = cut(compared.mapInPandas(thrifty(to_hub), large.schema.simpleString()[7:-1] + ", hub long, linked boolean"))
    links = links.unionByName(large.where("linked AND class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")))
    apart = large.where("NOT linked").groupBy("block").agg(F.count("*").alias("open"))
    work = large.join(apart, "block")
    slices = F.ceil(F.col("size") / block_size).cast("int")
    probes = F.ceil(F.col("open") / block_size).cast("int")
    work = work.withColumn("known", F.when(F.col("linked"), F.col("hub")).otherwise(F.col("class")))
    stored = work.select("block", "class", "n", "keys", "known", F.lit(False).alias("walks"), F.pmod(F.xxhash64("class"), slices).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), probes - 1)).alias("probe"))
    walking = work.where("NOT linked").select("block", "class", "n", "keys", "known", F.lit(True).alias("walks"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.pmod(F.xxhash64("class"), probes).cast("int").alias("probe"))

    def sliced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(parts, ["block", "slice", "probe"]):
            yield pd.DataFrame(tree_links(group[~group["walks"]], group[group["walks"]], percent), columns=["a", "b"])

    tasks = stored.unionByName(walking).repartition("block", "slice", "probe").sortWithinPartitions("block", "slice", "probe", "walks", "class")
    return links.unionByName(tasks.mapInPandas(thrifty(sliced), "a long, b long"))


def whole_groups(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that stand together, across the batches of a partition."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        change = (part[by] != part[by].shift()).any(axis=1).to_numpy()
        change[0] = bool(held) and tuple(held[-1][by].iloc[-1]) != tuple(part[by].iloc[0])
        at = 0
        for i in np.flatnonzero(change):
            if i > at:
                held.append(part.iloc[at:i])
            if held:
                yield pd.concat(held)
            held, at = [], i
        held.append(part.iloc[at:])
    if held:
        yield pd.concat(held)


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = N, percent: int = PERCENT, block_size: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return _grouped(spark, docs, n, percent, block_size).select("doc_id", "n_shingles", "component_id")


def _grouped(spark: SparkSession, docs: DataFrame, n: int, percent: int, block_size: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, group (the component among classes; null without n-grams) for every row."""
    found = cut(profile(docs, n))
    total = found.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // PER_RANGE)
    packed = _packed(docs, ranges, n)

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        out = _shared(part, ranges)
        give_back()
        return out

    def gathered(part: pd.DataFrame) -> pd.DataFrame:
        out = _survivors(part, percent)
        give_back()
        return out

    shared = packed.groupBy("range").applyInPandas(counted, "bucket int, classes binary, counts binary, keys binary")
    # As texts, since whole numbers next to nulls would reach pandas as doubles.
    sizes = found.where("class IS NOT NULL").groupBy("class").agg(F.max("n_shingles").alias("n")).select(
        F.pmod("class", F.lit(ranges)).cast("int").alias("bucket"), F.col("class").cast("string").alias("class"), F.col("n").cast("string").alias("n"))
    by_bucket = shared.unionByName(sizes, allowMissingColumns=True)
    sets = cut(by_bucket.groupBy("bucket").applyInPandas(gathered, "class long, n long, keys binary, rare array<long>"))
    joined = components(_links(spark, sets, percent, block_size))
    names = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"))
    linked = names.join(joined, names["class"] == joined["node"])
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    renamed = linked.join(least, "component").select("class", "component", "least")
    final = names.join(renamed, "class", "left").select("class", F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "class").alias("group"))
    return found.join(final, "class", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents whose id names their component, with all columns: one row for each component.

    Where one id stands on rows with different texts, each component keeps a row of its own text, the
    one with the least hash of those of the naming id. Texts without words are alike with nothing and
    stay, once for each id. Rows with a null id cannot be named as anyone's copy and stay.
    """
    found = _grouped(spark, docs.where("doc_id IS NOT NULL"), n, percent).where("doc_id = component_id")
    keep = found.groupBy("group", "doc_id", F.when(F.col("group").isNull(), F.col("text_key")).alias("wordless")).agg(F.min("text_key").alias("text_key"))
    keyed = docs.withColumn("_key", _text_key())
    keep = keep.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_kept"))
    kept = keyed.join(keep, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "_key"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
