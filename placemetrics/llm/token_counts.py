"""Token counts by prefix dynamic programming.

For every prefix of a piece there is one last token of its encoding: the token that ends the prefix
and whose neighbour, the last token of the shorter prefix before it, may stand beside it (the two
encode to themselves when joined). Filling prefixes from short to long gives the exact count at each
of them, so truncation and budgets are answered without encoding again. A text's counts are those of
its words added up; a word's table is made once per distinct word and task.

Null texts are empty and have 0 tokens. Repeated rows are counted each; rows with a null doc_id are
counted too. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from placemetrics.llm.bpe import VOCABULARY, load, split_words, vocabulary_file
from placemetrics.llm.words import WordRows, batches, kept, map_frames, sums

LIMIT = 2048
# Fixed value: how the vocabulary's pre-tokeniser splits text into contractions, letters, digits and other signs.
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Signs on which the two libraries might differ, and the beginning of a special token; such words take the long way.
UNSURE = re.compile(r"<\||[\x00-\x1f\x7f-\xa0\u00ad²³¹¼½¾]")


def byte_symbols() -> list[str]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in visible else chr(0x100 + extra)
        extra += b not in visible
    return out


class PrefixTable:
    """Counts at every prefix of a word."""

    def __init__(self, name: str = VOCABULARY) -> None:
        with open(vocabulary_file(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix, self.vocab = model["end_of_word_suffix"], model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.library = load(name)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.symbols = byte_symbols()
        self.stands: dict[tuple[str, str], bool] = {}
        # Last token and count of every prefix of the piece filled last.
        self.text, self.last, self.open_count = "", [""], [0]

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied to a short list of symbols, best rank first, leftmost among equals."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2:]]
        return symbols

    def beside(self, a: str, b: str) -> bool:
        """Whether b may follow a (a empty: whether b is the encoding of itself)."""
        known = self.stands.get((a, b))
        if known is None:
            plain = b.removesuffix(self.suffix)
            symbols = [*a, *plain]
            if plain != b:
                symbols[-1] += self.suffix
            known = self.merged(symbols) == ([a, b] if a else [b])
            if len(self.stands) > 2_000_000:
                self.stands.clear()
            self.stands[a, b] = known
        return known

    def piece(self, text: str, inner: bool = True) -> list[int]:
        """Count when the piece ends after 1, 2, ... symbols (inner False: of the whole piece alone)."""
        vocab, stands, suffix, last, open_count = self.vocab, self.stands, self.suffix, self.last, self.open_count
        ended: list[int] = []

        def final(end: int, mark: str) -> tuple[str, int]:
            for start in range(max(0, end - self.longest), end):
                token = text[start:end] + mark
                if token in vocab:
                    ok = stands.get((last[start], token))
                    if self.beside(last[start], token) if ok is None else ok:
                        return token, open_count[start] + 1
            raise ValueError(f"no encoding of {text[:end]!r}")

        # Prefixes shared with the piece before are known: words come in order, so most are.
        known, most = 0, min(len(last), len(text)) - 1
        while known < most and self.text[known] == text[known]:
            known += 1
        del last[known + 1:], open_count[known + 1:]
        self.text = text
        for end in range(known + 1, len(text)):
            token, count = final(end, "")
            last.append(token)
            open_count.append(count)
        if inner:
            ended = [final(end, suffix)[1] for end in range(1, len(text))]
        ended.append(final(len(text), suffix)[1])
        return ended

    def pieces(self, word: str) -> list[tuple[str, bool]]:
        """Symbol strings of a word's pieces, and whether each is a special token."""
        low = word.lower()
        if low.isascii() or (max(low) < "\u0250" and unicodedata.is_normalized("NFC", word)):
            # Latin words, the most by far, are split here as the library would.
            if low.isalpha():
                return [(low if low.isascii() else "".join(map(self.symbols.__getitem__, low.encode())), False)]
            if not UNSURE.search(low):
                return [(p if p.isascii() else "".join(map(self.symbols.__getitem__, p.encode())), False) for p in LATIN_PIECES.findall(low)]
        at = min(((word.find(s), s) for s in self.special if s in word), default=None)
        if at:
            return [*(self.pieces(word[:at[0]]) if at[0] else []), (at[1], True), *(self.pieces(word[at[0] + len(at[1]):]) if at[0] + len(at[1]) < len(word) else [])]
        return [(p, False) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]

    def counts(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i in sorted(range(len(words)), key=words.__getitem__):
            out[i] = self.count(words[i])
        return out

    def count(self, word: str) -> int:
        return sum(1 if special else self.piece(p, False)[-1] for p, special in self.pieces(word)) if word else 0

    def at_letters(self, word: str) -> list[int]:
        """Count when the word is cut after 1, 2, ... letters; words that are not one plain run of letters have only their whole count."""
        low = word.lower()
        found = self.pieces(word)
        if len(found) != 1 or found[0][1] or not low.isalpha() or len(low) != len(word):
            return [0] * (len(word) - 1) + [self.count(word)]
        counts, sizes = self.piece(found[0][0]), np.cumsum([len(c.encode()) for c in low])
        return [counts[n - 1] for n in sizes]


def _table(name: str) -> tuple[PrefixTable, WordRows]:
    def make() -> tuple[PrefixTable, WordRows]:
        table = PrefixTable(name)
        return table, WordRows(table.counts)

    return kept(("prefixes", name), make)


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, rows = _table(vocabulary)
        for part in parts:
            texts = part["text"].fillna("").tolist()
            n_tokens = np.zeros(len(texts), np.int64)
            for s in batches(texts):
                split = [split_words(t) for t in texts[s]]
                n_tokens[s] = sums(rows.get([w for ws in split for w in ws]), np.fromiter(map(len, split), np.int64))
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n_tokens, "over_limit": n_tokens > limit})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", keeps=True)


def cut_points(docs: DataFrame, budget: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars, n_tokens: the longest prefix whose own encoding has at most `budget` tokens.

    The cut lies after a letter of a plain word or between words; other words are not cut inside.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, rows = _table(vocabulary)
        for part in parts:
            out = []
            for doc_id, text in zip(part["doc_id"], part["text"].fillna(""), strict=True):
                words = split_words(text)
                total = np.cumsum(rows.get(words))
                whole = int(np.searchsorted(total, budget, side="right"))
                chars, tokens = sum(map(len, words[:whole])) + whole, int(total[whole - 1]) if whole else 0
                if whole == len(words):
                    chars -= 1
                else:
                    inside = [(i, c) for i, c in enumerate(table.at_letters(words[whole]), 1) if c and tokens + c <= budget]
                    chars, tokens = (chars + inside[-1][0], tokens + inside[-1][1]) if inside else (chars, tokens)
                out.append((doc_id, chars, tokens))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_chars long, n_tokens long", keeps=True)
