"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all ordered thresholds. Features
are hashed: every distinct word of a text, and its beginnings of 4 to 7 letters. Features that are
not clearly commoner in toxic rows are left out and the others fitted under an L1 penalty, so words
that tell nothing weigh exactly nothing however long a text is. The
expected severity is the sum over k of P(grade > k).

Fitting uses a bounded sample of labelled rows (`SAMPLE`). Labels that only say toxic or not become
three grades: toxic rows with more telling words than half of them are severe.

Null and empty texts have no features and so the severity of the intercept alone, which is never
toxic. Repeated rows are scored each; rows with a null doc_id too. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.llm.samples import labelled_texts
from placemetrics.llm.words import WordRows, batches, keep_rows, map_frames, thrifty

SAMPLE = 6_000
BITS = 20
BEGINNINGS = (4, 5, 6, 7)
PENALTY = 2e-4
TELLING, STRONG = 4.0, 20.0
MOST_OF_ONE = 3
TOXIC_AT = 0.4


def features_of(words: list[str]) -> np.ndarray:
    """Hashed features of each word: the word and its beginnings; 0 where there is none."""
    import xxhash
    out = np.zeros((len(words), 1 + len(BEGINNINGS)), np.int32)
    for i, word in enumerate(words):
        plain = "".join(c for c in word if c.isalnum()).lower()
        if plain:
            out[i, 0] = xxhash.xxh32_intdigest(plain) % ((1 << BITS) - 1) + 1
            for j, n in enumerate(BEGINNINGS, 1):
                if len(plain) >= n:
                    out[i, j] = xxhash.xxh32_intdigest("^" + plain[:n]) % ((1 << BITS) - 1) + 1
    return out


@dataclass
class Ordinal:
    """Weights by feature, one per grade but the last threshold."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, one row per value."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - linear[:, None], -60, 60)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int, penalty: float = PENALTY, steps: int = 1500) -> Ordinal:
    """Accelerated proximal gradient on the cumulative-link likelihood, sparse entries (row, col, value)."""
    n, top = len(grades), int(grades.max()) if len(grades) else 0
    share = np.array([(np.sum(grades <= k) + 0.5) / (n + 1) for k in range(top)])
    theta = np.log(share / (1 - share))
    w, look, last = np.zeros(size), np.zeros(size), 1.0
    scale = np.bincount(cols, values ** 2, size)
    # A bound of the curvature for every feature, with the mean number of features a row as partner.
    mean_row = np.bincount(rows, np.abs(values), n).mean() + 1 if n else 1
    step = 1.0 / (0.25 * np.sqrt(scale / max(n, 1) + 1e-12) * np.sqrt(mean_row) + 1e-3)
    low, high = grades - 1, grades
    for _ in range(steps):
        linear = np.bincount(rows, values * look[cols], n)
        edges = np.concatenate([[-1e9], theta, [1e9]])
        up, down = (1 / (1 + np.exp(-np.clip(edges[k + 1] - linear, -60, 60))) for k in (high, low))
        d_up, d_down, p = up * (1 - up), down * (1 - down), np.maximum(up - down, 1e-12)
        slope = (d_up - d_down) / p / n  # of the loss, by the linear part
        grad = np.bincount(cols, values * slope[rows], size)
        grad_theta = np.array([(-np.sum((d_up / p)[high == k]) + np.sum((d_down / p)[low == k])) / n for k in range(top)])
        moved = look - 0.5 * step * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - 0.5 * step * penalty, 0)
        theta = np.sort(theta - 1.0 * grad_theta)
        now = (1 + np.sqrt(1 + 4 * last * last)) / 2
        if np.dot(look - new, new - w) > 0:  # restart when momentum points the wrong way
            last = now = 1.0
        look, w, last = new + (last - 1) / now * (new - w), new, now
    return Ordinal(w, theta)


def telling(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, size: int, times: float) -> np.ndarray:
    """Features of at least 3 toxic rows whose share among those is so many times their share among clean rows."""
    in_toxic, in_clean = (np.bincount(cols[toxic[rows] == k], minlength=size) for k in (1, 0))
    return (in_toxic >= 3) & (in_toxic * (np.sum(toxic == 0) + 1) >= times * (in_clean + 0.5) * (np.sum(toxic == 1) + 1))


def severity_grades(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """0 for clean rows, 1 or 2 for toxic rows by how many strongly telling features they hold."""
    held = np.bincount(rows, telling(rows, cols, toxic, size, STRONG)[cols], len(toxic))
    middle = np.median(held[toxic == 1]) if np.any(toxic == 1) else 0
    return np.where(toxic == 1, 1 + (held > middle), 0)


def _distinct(text: str) -> list[str]:
    return list(dict.fromkeys(text.split()))


def sparse_rows(texts: DataFrame) -> DataFrame:
    """doc_id, toxic, features, counts (binary): the features of whole texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part["text"]:
                f, n = np.unique(features_of(_distinct(text)), return_counts=True)
                out.append((f[f > 0].astype("<i4").tobytes(), n[f > 0].astype("<i4").tobytes()))
            yield pd.DataFrame({"toxic": part["toxic"], "features": [a for a, _ in out], "counts": [b for _, b in out]})

    return texts.mapInPandas(thrifty(run), "toxic int, features binary, counts binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Model from at most `sample` labelled rows; without both labels, one that calls nothing toxic."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL")
    got = sparse_rows(labelled_texts(docs, known, sample)).toPandas()
    size = 1 << BITS
    toxic = got["toxic"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    if len(set(toxic)) < 2:
        return Ordinal(np.zeros(size), np.array([9.0, 12.0]))
    cols = [np.frombuffer(b, "<i4") for b in got["features"]]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    flat = np.concatenate(cols).astype(np.int64)
    values = np.concatenate([np.frombuffer(b, "<i4") for b in got["counts"]]).astype(float)
    grades = severity_grades(rows, flat, toxic, size)
    keep = telling(rows, flat, toxic, size, TELLING)[flat]
    rows, values = rows[keep], np.minimum(values[keep], MOST_OF_ONE)
    at, dense = np.unique(flat[keep], return_inverse=True)
    found = fit_ordinal(rows, dense, values, grades, len(at))
    weights = np.zeros(size)
    weights[at] = found.weights
    return Ordinal(weights, found.thresholds)


class Scorer:
    """Linear scores of whole texts under a model."""

    def __init__(self, model: Ordinal) -> None:
        self.model = model
        self.telling = np.append(0, np.flatnonzero(model.weights))  # number 0: a feature without weight
        number = np.zeros(len(model.weights), np.int32)
        number[self.telling[1:]] = np.arange(1, len(self.telling))
        self.rows = WordRows(lambda words: number[features_of(words)])

    def above(self, texts: list[str]) -> np.ndarray:
        linear = np.zeros(len(texts))
        for s in batches(texts):
            split = [_distinct(t) for t in texts[s]]
            found = self.rows.get([w for ws in split for w in ws])
            word, place = np.nonzero(found)
            # As in fitting, a feature counts MOST_OF_ONE times in a text at most, however many of its words have it.
            key = np.repeat(np.arange(len(split)), [len(ws) for ws in split])[word] * len(self.telling) + found[word, place]
            key, times = np.unique(key, return_counts=True)
            weights = np.minimum(times, MOST_OF_ONE) * self.model.weights[self.telling[key % len(self.telling)]]
            linear[s] = np.bincount(key // len(self.telling), weights, len(split))
        return self.model.above(linear)


def shared_model(docs: DataFrame, model: Ordinal):
    """The model for tasks: its few weights that are not zero are sent once to each executor."""
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))

    def scorer() -> Scorer:
        at, weight, thresholds = shared.value
        weights = np.zeros(1 << BITS)
        weights[at] = weight
        return Scorer(Ordinal(weights, thresholds))

    return scorer


def score(docs: DataFrame, model: Ordinal, toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), p_toxic, toxic for every row."""
    scorer = shared_model(docs, model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scorer()
        for part in parts:
            p = own.above(part["text"].fillna("").tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"], "severity": p.sum(axis=1).round(9), "grade": (p > 0.5).sum(axis=1), "p_toxic": p[:, 0].round(9), "toxic": p[:, 0] >= toxic_at})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(docs.select("doc_id", "text"), run, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean")


def clean(docs: DataFrame, model: Ordinal, toxic_at: float = TOXIC_AT) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    scorer = shared_model(docs, model)

    def decide():
        own = scorer()
        return lambda texts: own.above(texts)[:, 0] < toxic_at

    return keep_rows(docs, decide)
