"""Quality by Bradley-Terry pairwise ranking.

P(a better than b) = sigmoid(w.(x_a - x_b)), fitted by Newton steps on feature differences of pairs
of a good and a bad document. The ranking score w.x becomes a probability by a logistic curve fitted
to the labels, and documents are kept above a quantile of the scores.

Fitting uses a bounded sample of labelled rows (`SAMPLE`). Null and empty texts have only zero
features and are scored so. Repeated rows are scored each; rows with a null doc_id too, and they are
held out of nothing. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.llm.samples import labelled_texts
from placemetrics.llm.words import WordRows, batches, keep_rows, map_frames, sums, thrifty

SAMPLE = 12_000
PAIRS_PER_ROW = 8
RIDGE = 1e-3
PREDICT_AT = 0.3
N_FEATURES = 24


def word_traits(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), 12), np.float32)
    for i, w in enumerate(words):
        n = len(w)
        if not n:
            continue
        letters = sum(map(str.isalpha, w))
        digits = sum(map(str.isdigit, w))
        end = w[-1]
        out[i] = (1, n, letters, digits, w.isupper() and letters > 1, letters == 0, end in ".,;:", end in "!?", not end.isalnum() and end not in ".,;:!?\"')", w[:1].isupper(), n > 20, n - letters - digits)
    return out


def text_features(texts: list[str], rows: WordRows) -> np.ndarray:
    """One row of shares and counts for each text; 0 for a text without words."""
    out = np.zeros((len(texts), N_FEATURES))
    for s in batches(texts):
        split = [t.split() for t in texts[s]]
        sizes = np.fromiter(map(len, split), np.int64)
        flat = [w for ws in split for w in ws]
        total = sums(rows.get(flat).astype(np.float64), sizes) if flat else np.zeros((len(sizes), 12))
        at = rows.memo.numbers(flat, len(flat))
        same = np.zeros(len(flat))
        if len(flat) > 1:
            same[1:] = at[1:] == at[:-1]
        twice = np.zeros(len(flat))
        if len(flat) > 2:
            twice[2:] = at[2:] == at[:-2]
        n, chars = np.maximum(total[:, 0], 1), np.maximum(total[:, 1], 1)
        own = out[s]
        own[:, 0] = total[:, 1] / n / 10
        own[:, 1:4] = np.stack([total[:, 2], total[:, 3], total[:, 11]], 1) / chars[:, None]
        own[:, 4:11] = total[:, 4:11] / n[:, None]
        own[:, 11] = sums(same, sizes) / n
        own[:, 12] = sums(twice, sizes) / n
        own[:, 13] = np.array([len(set(ws)) for ws in split]) / n
        own[:, 14] = np.log1p(sizes) / 10
        lines = [t.split("\n") for t in texts[s]]
        own[:, 15] = np.array([1 - len(set(x)) / len(x) for x in lines])
        own[:, 16] = np.log1p(n / np.array([len(x) for x in lines])) / 10
        # Shares beyond a few hundredths say nearly all: the same, saturated.
        own[:, 17:20] = np.minimum(own[:, [4, 5, 7]] * 10, 1)
        own[:, 20:23] = np.minimum(own[:, [8, 11, 3]] * 10, 1)
        own[:, 23] = np.maximum(0, 0.6 - own[:, 13])
        own[sizes == 0] = 0
    return out


@dataclass
class Ranking:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float
    intercept: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.spread @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.rank(x) + self.intercept, -60, 60)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression of y on x, with a penalty for each weight."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge), x.T @ (p - y) / len(x) + ridge * w)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW) -> Ranking:
    """Ranking from features and 0/1 labels; without both labels, one that scores all alike."""
    k = x.shape[1]
    if len(set(good.tolist())) < 2:
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 1.0, 2.0)
    centre, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / spread, -20, 20)
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    fewer, rng = min(len(better), len(worse)), np.random.default_rng(7)
    n = max(len(better), len(worse), min(fewer * pairs_per_row, 200_000))
    a, b = better[np.arange(n) % len(better)], rng.permutation(worse)[np.arange(n) % len(worse)]
    a = rng.permutation(a)
    w = _newton(z[a] - z[b], np.ones(n), np.full(k, RIDGE))
    w /= max(np.abs(w).max(), 1e-9)
    rank = (x - centre) / spread @ w
    slope, intercept = _newton(np.stack([rank, np.ones(len(x))], 1), good.astype(float), np.array([1e-4, 0]))
    return Ranking(centre, spread, w, float(slope), float(intercept))


def features(texts: DataFrame, *columns: str) -> DataFrame:
    """The named columns with the features of `text` as an array."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = WordRows(word_traits)
        for part in parts:
            yield part[list(columns)].assign(x=list(text_features(part["text"].fillna("").tolist(), rows)))

    return texts.select(*columns, "text").mapInPandas(thrifty(run), ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL")
    got = features(labelled_texts(docs, known, sample), "quality").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), N_FEATURES)
    return fit(x, got["quality"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64))


def score(docs: DataFrame, model: Ranking, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, score (0 to 1), predicted for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = WordRows(word_traits)
        for part in parts:
            p = model.probability(text_features(part["text"].fillna("").tolist(), rows)).round(9)
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": p, "predicted": (p >= predict_at).astype(int)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def keep_threshold(scored: DataFrame, low_share: float, most: float = PREDICT_AT) -> float:
    """Score that the low share of all documents lies under, but not above `most`; 0 for an empty table."""
    value = scored.agg(F.percentile_approx("score", low_share, 100_000)).first()[0]
    return min(value or 0.0, most)


def good(docs: DataFrame, model: Ranking, threshold: float) -> DataFrame:
    """The documents that score the threshold or more, with all their columns."""
    def decide():
        rows = WordRows(word_traits)
        return lambda texts: model.probability(text_features(texts, rows)).round(9) >= threshold

    return keep_rows(docs, decide)
