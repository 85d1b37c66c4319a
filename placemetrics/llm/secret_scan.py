"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Candidates are all runs of 12 or more token characters, with digits or without. The network (numpy)
reads 32 characters before a place, 32 of the candidate from there, and 16 after: learned character
vectors, one convolution, its largest answer before, in and after, a logistic layer. Of a longer
candidate it reads every such piece, each half a piece after the last, and the best answer counts.

Labels do not follow from what the patterns touch. Secrets are the values of pattern matches, without
keyword or prefix and in the surroundings of other runs, and values made at random in the forms of
keys and tokens. Plain are runs shaped like words that stand in two different surroundings
at least, and names, dates and numbers made of such words. All other runs are not learned from.
The answer is calibrated by a logistic curve on findings kept back, and the threshold is the largest
that still finds `RECALL` of the secrets kept back. Spans of the patterns always stay; the network
adds spans of whole candidates, also of those a pattern only touches: a key it finds leaves no end.

Training reads every document and learns from every distinct value found. Values are dealt by hash to
parts of about `PART`; each part takes Adam steps over its own values from shared weights, which are
averaged after every round. Calibration and threshold are sums and a rank over what all parts kept back.
Null and empty texts have no spans. Repeated rows are scanned each; rows with a null doc_id too. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.ranks import exact_quantiles
from placemetrics.llm.words import map_frames, pieces, thrifty
from placemetrics.session import cut

# The patterns every scan finds, by the contract of the query.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "cnn")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SHAPED = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[-_/=+])+")
BEFORE, OWN, AFTER = 32, 32, 16
PARTS = (0, BEFORE, BEFORE + OWN, BEFORE + OWN + AFTER)
#: Values of a label in one part, values made there, and how few of a label a part may have before they are dealt to several.
PART, MADE, FEW = 6_000, 3_000, 500
#: Steps where one part holds all; of several parts each takes fewer, enough to draw about every window once.
STEPS, SHARED, ROUNDS = 500, 200, 5
WEIGHTS = ("chars", "filters", "bias", "out", "shift")
RECALL = 0.98

Span = tuple[int, int, int]  # start, kind by its place in KINDS, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the patterns, and all candidate runs. Access and hexadecimal matches lie inside runs."""
    spans: list[Span] = []
    runs: list[tuple[int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for run in RUN.finditer(text):
        word, at = run[0], run.start()
        if "AKIA" in word:
            spans += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(word) if m.end() - m.start() >= LEAST["access"]]
        if len(word) >= LEAST["hex"]:
            spans += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(word) if m.end() - m.start() >= LEAST["hex"]]
        runs.append((at, run.end()))
    return sorted(spans), runs


class Cover:
    """Which ranges touch one of these spans, sorted by start: found by binary search, however many there are."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts = [a for a, _, _ in spans]
        self.reach = list(accumulate((b for _, _, b in spans), max))

    def touches(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start

    def holds(self, start: int, end: int) -> bool:
        """Whether the range lies within one span."""
        before = bisect_right(self.starts, start)
        return before > 0 and self.reach[before - 1] >= end


def codes(text: str) -> np.ndarray:
    """Character codes: ASCII as it is, others 127, nothing 0."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127).astype(np.uint8)


def window(text: str, start: int, end: int | None = None) -> np.ndarray:
    """Codes before a place, of the run from there, and after that piece (by default of the run that starts there)."""
    if end is None:
        run = RUN.match(text, start)
        end = run.end() if run else min(len(text), start + OWN)
    end = min(end, start + OWN)
    return codes(text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + text[start:end].ljust(OWN, "\0") + text[end:end + AFTER].ljust(AFTER, "\0"))


@dataclass
class Network:
    """Character vectors, filters of five characters, logistic layer, calibration and threshold."""

    chars: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    intercept: float = 0.0
    threshold: float = 0.5

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of every place, and per filter the best place and answer before, in and after the run."""
        e = self.chars[x]
        width = self.filters.shape[0]
        stack = np.concatenate([e[:, i:e.shape[1] - width + 1 + i] for i in range(width)], axis=2)
        a = np.maximum(stack @ self.filters.reshape(-1, self.filters.shape[2]) + self.bias, 0)
        places = np.stack([a[:, p:q - width + 1].argmax(1) + p for p, q in zip(PARTS, PARTS[1:])], 1)  # row, part, filter
        pooled = np.concatenate([np.take_along_axis(a, places[:, k, None], 1)[:, 0] for k in range(places.shape[1])], 1)
        return stack, places, pooled

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.hidden(x[i:i + 500])[2] @ self.out + self.shift for i in range(0, len(x), 500)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(x) + self.intercept, -60, 60)))


def start(part: int = 0) -> tuple[Network, np.random.Generator]:
    """The network before training, alike for all parts, and the random numbers of a part after it."""
    rng = np.random.default_rng(11)
    net = Network(rng.normal(0, 0.3, (128, 8)), rng.normal(0, 0.15, (5, 8, 24)), np.zeros(24), rng.normal(0, 0.15, 24 * (len(PARTS) - 1)), 0.0)
    return net, np.random.default_rng([11, part]) if part else rng


def descend(net: Network, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, steps: int, size: int = 128) -> None:
    """Adam steps on batches of both labels alike; the network is changed in place."""
    yes, no = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    state: dict[str, tuple] = {}

    def adam(name: str, grad: np.ndarray, t: int) -> None:
        m, v = state.get(name, (np.zeros_like(grad), np.zeros_like(grad)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        state[name] = m, v
        setattr(net, name, getattr(net, name) - 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8))

    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(yes, size // 2), rng.choice(no, size // 2)])
        stack, places, pooled = net.hidden(x[pick])
        delta = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -60, 60))) - y[pick]) / size
        back_pool = delta[:, None] * net.out * (pooled > 0)
        flat_filters = net.filters.reshape(-1, 24)
        grad_filters, grad_chars = np.zeros_like(flat_filters), np.zeros_like(net.chars)
        rows = np.arange(size)[:, None]
        for k in range(places.shape[1]):
            part, place = back_pool[:, 24 * k:24 * k + 24], places[:, k]
            seen = stack[rows, place]  # row, filter, inputs
            grad_filters += np.einsum("rfi,rf->if", seen, part)
            to_chars = np.einsum("rf,if->rfi", part, flat_filters).reshape(size, 24, 5, 8)
            for i in range(5):
                np.add.at(grad_chars, x[pick][rows, place + i], to_chars[:, :, i])
        grads = {"out": pooled.T @ delta, "shift": np.float64(delta.sum()), "bias": back_pool.reshape(size, -1, 24).sum((0, 1)),
                 "filters": grad_filters.reshape(net.filters.shape), "chars": grad_chars}
        for name, grad in grads.items():
            adam(name, grad, t)


def curve_sums(z: np.ndarray, target: np.ndarray, slope: float, intercept: float) -> list[float]:
    """What a Newton step of the logistic curve needs to know of the findings kept back."""
    p = 1 / (1 + np.exp(-np.clip(slope * z + intercept, -60, 60)))
    w = p * (1 - p) + 1e-6
    return [float(v.sum()) for v in (w * z * z, w * z, w, (p - target) * z, p - target)]


def calibrate(net: Network, sums: Callable[[float, float], Sequence[float]]) -> None:
    """Logistic curve on the findings kept back, by Newton steps from their sums."""
    for _ in range(50):
        zz, z, one, ez, e = sums(net.slope, net.intercept)
        move = np.linalg.solve(np.array([[zz, z], [z, one]]) + 0.1 * np.eye(2), np.array([ez, e]) + 0.1 * np.array([net.slope - 1, net.intercept]))
        net.slope, net.intercept = float(net.slope - np.clip(move[0], -1, 1)), float(net.intercept - np.clip(move[1], -1, 1))
        if np.abs(move).max() < 1e-9:
            break


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, size: int = 128, recall: float = RECALL) -> Network:
    """Network from windows and 0/1 labels by Adam; without both labels, one that adds nothing."""
    net, rng = start()
    if len(set(y.tolist())) < 2 or min(np.sum(y == 0), np.sum(y == 1)) < 8:
        net.threshold = 2.0
        return net
    order = rng.permutation(len(x))
    back, train = order[:len(x) // 4], order[len(x) // 4:]
    descend(net, x[train], y[train], rng, steps, size)
    z, target = net.logit(x[back]), y[back].astype(float)
    calibrate(net, lambda slope, intercept: curve_sums(z, target, slope, intercept))
    found = np.sort(net.probability(x[back][target == 1]))
    net.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 2.0
    return net


def value_of(text: str, span: Span) -> str:
    """What a pattern match holds, without its keyword or prefix."""
    a, kind, b = span
    return ASSIGN.match(text, a)[2] if kind == 0 else text[a + 4:b] if kind == 1 else text[a:b]


def findings(docs: DataFrame) -> DataFrame:
    """Value, window and label (1 secret, 0 plain in shape) of what these documents tell for sure; other runs are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part["text"].fillna(""):
                spans, runs = base_spans(text)
                taken = Cover(spans)
                values = ((value_of(text, s), s) for s in spans)
                out += [(v, window(text, s[2] - len(v), s[2]).tobytes(), 1) for v, s in values if RUN.fullmatch(v) and not v.isdigit() and not SHAPED.fullmatch(v)]
                out += [(text[a:b], window(text, a, b).tobytes(), 0) for a, b in runs if SHAPED.fullmatch(text, a, b) and not taken.touches(a, b)]
            yield pd.DataFrame(out, columns=["value", "window", "secret"])

    return docs.select("text").mapInPandas(thrifty(run), "value string, window binary, secret int")


def made_secrets(rng: np.random.Generator, n: int) -> list[str]:
    """Random values in the forms of keys and tokens, with and without prefixes of random letters."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", upper + lower, lower + digits, upper + digits, "0123456789abcdef", "0123456789ABCDEF"]

    def some(letters: str, size: int) -> str:
        return "".join(np.array(list(letters))[rng.integers(0, len(letters), size)])

    out = []
    for k in range(n):
        value = some(kinds[k % len(kinds)], int(rng.integers(16, 65)))
        if rng.random() < 0.4:
            value = "".join(some(lower, int(rng.integers(2, 6))) + "_-"[int(rng.integers(2))] for _ in range(int(rng.integers(1, 3)))) + value
        if k % len(kinds) == 1 and rng.random() < 0.5:
            value += "=" * int(rng.integers(1, 3))
        out.append(value)
    return out


def made_plain(rng: np.random.Generator, n: int, words: list[str]) -> list[str]:
    """Names, dates and numbers as plain texts hold them: words and short numbers with separators."""
    out = []
    for k in range(n):
        year, month, day = int(rng.integers(1900, 2100)), int(rng.integers(1, 13)), int(rng.integers(1, 29))
        own = [words[i][:int(rng.integers(3, 12))] for i in rng.integers(0, len(words), 3)]
        mark = "-_/="[int(rng.integers(4))]
        out.append([mark.join([*own[:2], str(year)]), mark.join([own[0], str(int(rng.integers(0, 100))), *own[1:]]), f"{year}-{month:02}-{day:02}T{day:02}",
                    f"{year}{month:02}{day:02}{int(rng.integers(0, 10**6)):06}", mark.join([str(year), f"{month:02}", *own]), mark * int(rng.integers(12, 60)), mark.join(own)][k % 7])
    return [w for w in out if RUN.fullmatch(w)]


def examples(secrets: pd.DataFrame, plain: pd.DataFrame, made: int = MADE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels. Every value also stands in surroundings of other plain runs, so that these tell nothing by themselves."""
    if not len(plain):
        return np.zeros((0, PARTS[-1]), np.uint8), np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    words = plain["value"].tolist()
    around = np.frombuffer(b"".join(plain["window"]), np.uint8).reshape(len(plain), -1)

    def placed(values: list[str]) -> np.ndarray:
        x = around[rng.integers(0, len(around), len(values))].copy()
        if values:
            x[:, BEFORE:BEFORE + OWN] = [codes(v[:OWN].ljust(OWN, "\0")) for v in values]
        return x

    yes = placed(secrets["value"].tolist() + made_secrets(rng, made))
    no = np.concatenate([around, placed(words), placed([w.upper() for w in words]), placed(made_plain(rng, made // 2, words))])
    return np.concatenate([yes, no]), np.repeat([1, 0], [len(yes), len(no)])


def dealt(docs: DataFrame, most: int = PART) -> tuple[DataFrame, int]:
    """Every distinct value of all documents with one of its windows, a part to a partition, and the number of parts.

    Both labels are dealt evenly; one with few values is dealt to several parts, so that none lacks a label.
    """
    order = F.struct(F.xxhash64("value", "window"), "window")
    values = findings(docs).groupBy("secret", "value").agg(F.min(order)["window"].alias("window"), (F.min("window") < F.max("window")).alias("moved"))
    values = cut(values.where("secret = 1 OR moved").select("secret", "value", "window", F.xxhash64("value").alias("hash")))
    counts = {r.secret: r["count"] for r in values.groupBy("secret").count().collect()}
    parts = max(1, -(-max(counts.values(), default=0) // most))
    times = {k: min(parts, max(1, -(-parts * min(FEW, most) // n))) for k, n in counts.items()}
    copies = F.when(F.col("secret") == 1, times.get(1, 1)).otherwise(times.get(0, 1))
    part = F.explode(F.transform(F.sequence(F.lit(0), copies - 1), lambda i: F.pmod(F.col("hash") + i, F.lit(parts)).cast("int")))
    return cut(values.withColumn("part", part).repartitionById(parts, F.col("part"))), (parts if 0 in counts else 0)


def part_windows(values: DataFrame) -> DataFrame:
    """Number, windows and labels of every part, a row each."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [r for r in rows if len(r)]
        if held:
            own = pd.concat(held).sort_values(["hash", "value"])
            part = int(own["part"].iloc[0])
            x, y = examples(own[own["secret"] == 1], own[own["secret"] == 0], seed=7 + part)
            yield pd.DataFrame({"part": [part], "windows": [x.tobytes()], "labels": [y.astype(np.uint8).tobytes()]})

    return values.mapInPandas(thrifty(run), "part int, windows binary, labels binary")


def opened(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for frame in rows:
        for part, windows, labels in frame.itertuples(index=False):
            yield part, np.frombuffer(windows, np.uint8).reshape(-1, PARTS[-1]), np.frombuffer(labels, np.uint8).astype(np.int64)


def train(docs: DataFrame, most: int = PART, recall: float = RECALL) -> Network:
    """Network from all documents: parts of about `most` values of pattern matches and as many plain runs, in tasks of their own.

    The weights of a round are the mean of those the parts reach from the same weights. One part needs one round.
    """
    values, parts = dealt(docs, most)
    net, _ = start()
    if not parts:
        net.threshold = 2.0
        return net
    rounds, steps = (1, STEPS) if parts == 1 else (ROUNDS, SHARED // ROUNDS)
    held = cut(part_windows(values))

    def learnt(net: Network, turn: int) -> DataFrame:
        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, x, y in opened(rows):
                own = replace(net)
                rng = start(part)[1]
                train_on = rng.permutation(len(x))[len(x) // 4:]
                descend(own, x[train_on], y[train_on], np.random.default_rng([11, part, turn]) if turn else rng, steps)
                flat = np.concatenate([np.ravel(getattr(own, w)) for w in WEIGHTS])
                yield pd.DataFrame({"place": np.arange(len(flat)), "weight": np.round(flat * 2.0 ** 40).astype(np.int64)})

        return held.mapInPandas(thrifty(run), "place int, weight long")

    def kept_back(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x, y in opened(rows):
            back = start(part)[1].permutation(len(x))[:len(x) // 4]
            yield pd.DataFrame({"z": net.logit(x[back]), "secret": y[back]})

    for turn in range(rounds):
        # whole numbers add up alike in any order; there are as many as the network has weights
        total = learnt(net, turn).groupBy("place").agg((F.sum(F.col("weight").cast("decimal(38,0)")) / F.count("weight")).cast("double").alias("mean"))
        flat = np.array([r["mean"] for r in total.orderBy("place").collect()]) / 2.0 ** 40
        at = 0
        for name in WEIGHTS:
            old = np.asarray(getattr(net, name))
            setattr(net, name, flat[at:at + old.size].reshape(old.shape))
            at += old.size
    scores = cut(held.mapInPandas(thrifty(kept_back), "z double, secret int"))

    def sums(slope: float, intercept: float) -> list[float]:
        z, y = F.col("z"), F.col("secret")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z * slope + intercept))))
        w = p * (1 - p) + 1e-6
        return list(scores.agg(*(F.sum(c) for c in (w * z * z, w * z, w, (p - y) * z, p - y))).first())

    calibrate(net, sums)
    rising = F.col("z") if net.slope >= 0 else -F.col("z")
    ranked = exact_quantiles(scores.where("secret = 1").select(F.lit(0).alias("one"), rising.alias("z")), ["one"], "z",
                             {"least": F.floor(F.lit(1 - recall) * F.col("total_n")) + 1}).first()
    if ranked is None:
        net.threshold = 2.0
    else:
        z = ranked["least"] if net.slope >= 0 else -ranked["least"]
        net.threshold = float(1 / (1 + np.exp(-np.clip(net.slope * z + net.intercept, -60, 60))))
    return net


def all_spans(text: str, net: Network) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and all spans."""
    base, runs = base_spans(text)
    taken = Cover(base)
    free = [(a, b) for a, b in runs if not taken.holds(a, b)]
    if not free or net.threshold > 1:
        return base, base
    starts = [range(a, max(a + 1, b - OWN // 2), OWN // 2) for a, b in free]
    each = net.probability(np.stack([window(text, i, b) for (_, b), own in zip(free, starts, strict=True) for i in own]))
    p = np.maximum.reduceat(each, [0, *accumulate(map(len, starts[:-1]))])
    return base, sorted(base + [(a, 3, b) for (a, b), q in zip(free, p, strict=True) if q >= net.threshold])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part["text"].fillna(""):
                base, spans = all_spans(text, net)
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"]).assign(doc_id=part["doc_id"].array)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, net: Network, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for a, _, b in all_spans(text, net)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network) -> DataFrame:
    """The same rows and columns; spans in `text` replaced, `n_chars` (if there) counted again."""

    def run(parts):
        import pyarrow as pa
        for part in pieces(parts):
            old = part.column("text").to_pylist()
            new = [None if t is None else redacted(t, net) for t in old]
            made = {"text": new}
            if "n_chars" in part.schema.names:
                made["n_chars"] = [c if a == b else len(b) for a, b, c in zip(old, new, part.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else part.column(f.name) for f in part.schema], schema=part.schema)

    return docs.mapInArrow(thrifty(run), docs.schema)
