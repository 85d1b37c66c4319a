"""Language identification by interpolated Kneser-Ney character models.

Each language has a model over character 4-grams of lower-cased words with their borders. The
highest order uses counts, lower orders the number of distinct letters seen before, each discounted
by its own constant and interpolated down to an even choice of characters. Tables are sorted arrays
of packed 4-grams, read by binary search. A text goes to the language with the lowest cross-entropy
per character. The margin to the second, times the root of the length, gives the score by a logistic
curve; texts scored under the rejection threshold are marked `rejected`. Curve and threshold are fitted to
labelled texts of one fold in `FOLDS`, dealt by text so that copies stay together, as models without that fold
score them.

Counts cover all labelled documents, and a model holds every 4-gram counted, so that discounts,
continuation counts and totals are those of the whole corpus. Letters take 16 bits each: those beyond the
basic plane share the codes that no letter of it has, by remainder, so letters of one script stay apart. What is sent to each executor grows with
the distinct 4-grams, not with the texts. Texts that are null or have no letter are `und` with score 0. Repeated rows are predicted each; rows with
a null doc_id too, but nothing is learned from them. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.llm.samples import hashed_share
from placemetrics.llm.words import WordRows, batches, map_frames, sums
from placemetrics.session import cut

ORDER = 4
CALIBRATION = 4_000
FOLDS = 5
REJECT_RATE = 0.01
UNKNOWN = "und"
EDGE = 32  # the code point of a blank stands for a word's borders
#: Surrogates and private use, which are never letters.
NO_LETTERS = (0xD800, 0xF8FF)


def letters_of(word: str) -> str:
    return "".join(filter(str.isalpha, word)).lower()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of words with three borders before and one after, and how many each word has."""
    plain = [letters_of(w) for w in words]
    sizes = np.array([len(p) + 1 if p else 0 for p in plain], np.int64)
    text = "".join("   " + p + " " for p in plain if p)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    low, high = NO_LETTERS
    codes = np.where(codes > 0xFFFF, low + codes % (high - low + 1), codes).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.int64), sizes
    packed = (codes[:-3] << np.uint64(48)) | (codes[1:-2] << np.uint64(32)) | (codes[2:-1] << np.uint64(16)) | codes[3:]
    lengths = sizes[sizes > 0] + 3
    ends = np.cumsum(lengths)
    keep = np.ones(len(codes), bool)
    for back in (1, 2, 3):  # windows that would reach into the next word
        keep[ends - back] = False
    return packed[keep[:-3]].view(np.int64), sizes


@dataclass
class Level:
    """One order: sorted n-grams with their discounted share, sorted contexts with the weight passed down."""

    keys: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    down: np.ndarray


def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class KneserNey:
    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> None:
        self.levels: list[Level] = []
        keys = keys.view(np.uint64)
        for n in range(order, 0, -1):
            at = np.argsort(keys)
            keys, counts = keys[at], counts[at].astype(np.float64)
            one, two = np.sum(counts == 1), np.sum(counts == 2)
            discount = one / (one + 2 * two) if one and two else 0.5
            context = keys >> np.uint64(16)
            names, where, kinds = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(where, counts, len(names))
            self.levels.append(Level(keys, np.maximum(counts - discount, 0) / total[where], names, discount * kinds / total))
            # Lower order: how many distinct characters stand before the shorter gram.
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True) if n > 1 else (keys, counts)
        self.even = 1.0 / (len(self.levels[-1].keys) + 1)

    def log_probability(self, packed: np.ndarray) -> np.ndarray:
        wanted = packed.view(np.uint64)
        p = np.full(len(wanted), self.even)
        for n, level in enumerate(reversed(self.levels), 1):
            own = wanted & np.uint64((1 << 16 * n) - 1) if n < ORDER else wanted
            p = look(level.keys, level.share, own, 0.0) + look(level.contexts, level.down, own >> np.uint64(16), 1.0) * p
        return np.log(p)


def gram_counts(docs: DataFrame, least_share: float = 0.0) -> DataFrame:
    """lang, gram, n over all whole texts; where a least share is asked for, only the n-grams of that share of their language or more."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = defaultdict(list)

        def flush(lang: str) -> pd.DataFrame:
            keys, at = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held[lang]]), len(keys)).astype(np.int64)
            held[lang] = [(keys, n)]
            return pd.DataFrame({"lang": lang, "gram": keys, "n": n})

        for part in parts:
            for lang, texts in part.groupby("lang")["text"]:
                rows = texts.tolist()
                for s in batches(rows):
                    counted: Counter = Counter()
                    for t in rows[s]:
                        counted.update(t.split())
                    packed, sizes = grams(list(counted))
                    held[lang].append((packed, np.repeat(np.fromiter(counted.values(), np.int64), sizes)))
                    if len(held[lang]) > 8:
                        flush(lang)
        for lang in held:
            yield flush(lang)

    counted = cut(docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    if not least_share:
        return counted
    least = counted.groupBy("lang").agg((F.sum("n") * least_share).alias("least"))
    return counted.join(least, "lang").where("n >= least").select("lang", "gram", "n")


class Models:
    """One model per language, in order of name, with calibration."""

    def __init__(self, table: pd.DataFrame) -> None:
        self.names = sorted(table["lang"].unique())
        self.models = [KneserNey(t["gram"].to_numpy(np.int64), t["n"].to_numpy(np.int64)) for _, t in sorted(table.groupby("lang", observed=True), key=lambda x: x[0])]
        self.slope, self.intercept, self.reject_under = 4.0, 0.0, 0.0

    def word_rows(self) -> WordRows:
        def compute(words: list[str]) -> np.ndarray:
            packed, sizes = grams(words)
            keys, at = np.unique(packed, return_inverse=True)
            out = [sums(m.log_probability(keys)[at], sizes) for m in self.models]
            return np.stack([*out, sizes.astype(np.float64)], 1)
        return WordRows(compute)

    def entropy(self, texts: list[str], rows: WordRows) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character and language, and the number of characters."""
        total = np.zeros((len(texts), len(self.models) + 1))
        for s in batches(texts):
            split = [t.split() for t in texts[s]]
            flat = [w for ws in split for w in ws]
            if flat:
                total[s] = sums(rows.get(flat), np.fromiter(map(len, split), np.int64))
        return -total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]

    def strength(self, entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Margin of the best language over the second times the root of the length."""
        if entropy.shape[1] < 2:
            return np.sqrt(size)
        low = np.sort(entropy, axis=1)
        return (low[:, 1] - low[:, 0]) * np.sqrt(size)

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        if not self.models or not texts:
            return
        entropy, size = self.entropy(texts, self.word_rows())
        use = size > 0
        x, y = self.strength(entropy, size)[use], (np.array(self.names)[entropy.argmin(1)] == np.array(langs))[use].astype(float)
        if len(y) < 20:
            return
        design = np.stack([x, np.ones_like(x)], 1)
        w = np.array([1.0, 0.0])
        for _ in range(60):  # one imagined miss and hit at strength 0 keep the curve finite
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            half = 1 / (1 + np.exp(-np.clip(w[1], -30, 30)))
            grad = design.T @ (p - y) + np.array([0.01 * (w[0] - 1), 2 * (half - 0.5)])
            hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0.01, 2 * half * (1 - half) + 1e-6])
            w -= np.clip(np.linalg.solve(hess, grad), -1, 1)
        self.slope, self.intercept = float(max(w[0], 0.01)), float(w[1])
        self.reject_under = float(np.quantile(self.probability(x), REJECT_RATE))

    def probability(self, strength: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * strength + self.intercept, -30, 30)))


def fold_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all documents, and `n_apart`, those of the fold that calibrates; counted in one pass."""
    named = docs.withColumn("lang", F.concat(F.when(calibrates(), "1").otherwise("0"), "lang"))
    apart = F.when(F.startswith("lang", F.lit("1")), F.col("n")).otherwise(0)
    return gram_counts(named).groupBy(F.substr("lang", F.lit(2)).alias("lang"), "gram").agg(F.sum("n").alias("n"), F.sum(apart).alias("n_apart"))


def calibrates() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0


def train(docs: DataFrame, calibration: int = CALIBRATION) -> Models | None:
    """Models of all languages of the documents given; None where none has a language."""
    table = fold_counts(docs).toArrow().to_pandas(strings_to_categorical=True)
    if not len(table):
        return None
    rest = table.assign(n=table["n"] - table["n_apart"])
    apart = Models(rest[rest["n"] > 0])
    sample = hashed_share(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & calibrates()).select("doc_id", "text", "lang"), calibration).select("text", "lang").toPandas()
    apart.calibrate(sample["text"].tolist(), sample["lang"].tolist())
    models = Models(table)
    models.slope, models.intercept, models.reject_under = apart.slope, apart.intercept, apart.reject_under
    return models


def predict(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        rows = own.word_rows() if own else None
        for part in parts:
            texts = part["text"].fillna("").tolist()
            if own:
                entropy, size = own.entropy(texts, rows)
                p = np.where(size > 0, own.probability(own.strength(entropy, size)), 0.0).round(9)
                names = np.where(size > 0, np.array(own.names, object)[entropy.argmin(1)], UNKNOWN)
                rejected = (size == 0) | (p < own.reject_under)
            else:
                p, names, rejected = np.zeros(len(texts)), np.full(len(texts), UNKNOWN, object), np.ones(len(texts), bool)
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": names, "score": p, "rejected": rejected})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
