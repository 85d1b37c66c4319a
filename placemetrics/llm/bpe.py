"""Exact word-level byte-pair encoding with a public vocabulary.

White space separates words for the normaliser and the pre-tokeniser of the vocabulary alike, so a
text's ids are the ids of its words one after the other. Words are cut at spaces and line feeds
only; everything else inside them (other white space, special strings, accents) is left to the
library. Distinct words are put together once per task (`words.Memo`); of Latin words the pieces of
letters, digits and signs are told apart here, and each distinct piece goes through the merges once.

Long unsplit stretches are encoded as a tree: halves apart, then joined. At a join a window of
tokens on both sides is encoded anew and grows until its outermost tokens equal those of both
sides. Then every two neighbouring tokens of the joined list stand next to each other in some true
encoding, which makes the list the encoding of the whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from placemetrics.llm.words import LIMIT, Memo, kept

VOCABULARY = "word_bpe_49k.json"
LEAF_SYMBOLS = 2048


def vocabulary_file(name: str) -> str:
    """A path as it is; a bare name among the installed public vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def load(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary_file(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_words(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Symbols:
    """The vocabulary's merges over strings of symbols, without normaliser and pre-tokeniser."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        with open(vocabulary_file(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.closed_model = Tokenizer(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix))
        self.bare_model = Tokenizer(BPE(vocab=model["vocab"], merges=merges))

    def encode(self, text: str, closed: bool) -> tuple[list[int], list[int]]:
        """Ids and ends of the tokens; closed: the text ends a word."""
        e = (self.closed_model if closed else self.bare_model).encode(text, add_special_tokens=False)
        return e.ids, [end for _, end in e.offsets]

    def tree(self, text: str, closed: bool = True, leaf: int = LEAF_SYMBOLS) -> tuple[list[int], list[int]]:
        """Tree concatenation of one unsplit string of symbols."""
        if len(text) <= leaf:
            return self.encode(text, closed)
        half = len(text) // 2
        left, left_ends = self.tree(text[:half], False, leaf)
        right, right_ends = self.tree(text[half:], closed, leaf)
        right_ends = [half + e for e in right_ends]
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            start, end = left_ends[a - 1] if a else 0, right_ends[b - 1]
            ids, ends = self.encode(text[start:end], closed and end == len(text))
            ends = [start + e for e in ends]
            on_left = a == 0 or (ids[0] == left[a] and ends[0] == left_ends[a])
            on_right = b == len(right) or (ids[-1] == right[b - 1] and ends[-2:-1] == right_ends[b - 2:b - 1])
            if on_left and on_right and (len(ids) > 1 or (a == 0 and b == len(right))):
                return left[:a] + ids + right[b:], left_ends[:a] + ends + right_ends[b:]
            width *= 2


class Ids:
    """Lists of ids by number, one after the other in growing arrays."""

    def __init__(self) -> None:
        self.ids, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        last = self.count + len(lengths)
        while last > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[self.count:last] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count:last] = lengths
        self.used, self.count = self.used + len(ids), last

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the lists with these numbers, and how many each has."""
        counts = self.lengths[at]
        # Place of every id: the start of its list, and then one further for each id of the list.
        place = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return self.ids[place], counts


class PieceEncoder:
    """Ids of Latin words, many words in one call: split into pieces together, each distinct piece through the merges once.

    A piece's last token ends a word, which tells the pieces of a call of the merges apart again.
    """

    CALL = 2_000

    def __init__(self, name: str, limit: int) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        from placemetrics.llm.token_counts import LATIN_PIECES, UNSURE, byte_symbols
        with open(vocabulary_file(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Pieces come once each, so the library's own memory of them would only cost.
        self.merges = Tokenizer(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.symbols, self.limit = dict(enumerate(byte_symbols())), limit
        # Words stand with a blank between them; a word with a sign that is not plainly Latin is left to the library.
        self.find = re.compile(LATIN_PIECES.pattern + "| ").findall
        self.odd = re.compile(f"[^\x00-\u024f]|{UNSURE.pattern}")
        self._reset()

    def _reset(self) -> None:
        self.memo, self.known = Memo(), Ids()
        # Number 0 is the blank between words, without ids.
        self.memo.numbers([" "], 1)
        self.memo.fresh = []
        self.known.append(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def left_out(self, words: list[str]) -> np.ndarray:
        """Which words are not plainly Latin."""
        joined = " ".join(words).lower()
        blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        out = np.zeros(len(words), bool)
        out[np.searchsorted(blanks, [m.start() for m in self.odd.finditer(joined)])] = True
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plainly Latin words one after the other, and how many each has."""
        if len(self.memo) > self.limit:
            self._reset()
        pieces = self.find(" ".join(words).lower())
        at = self.memo.numbers(pieces, len(pieces))
        fresh, self.memo.fresh = self.memo.fresh, []
        for i in range(0, len(fresh), self.CALL):
            symbols = [p if p.isascii() else p.encode().decode("latin-1").translate(self.symbols) for p in fresh[i:i + self.CALL]]
            ids = np.array(self.merges.encode_batch_fast([" ".join(symbols)], add_special_tokens=False)[0].ids, np.uint32)
            self.known.append(ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        ids, counts = self.known.get(at)
        ends = np.append(np.flatnonzero(at == 0), len(at))
        return ids, np.diff(np.append(0, np.cumsum(counts))[ends], prepend=0)


class WordEncoder:
    """Ids of whole texts, word by word."""

    def __init__(self, name: str = VOCABULARY, limit: int = LIMIT, leaf: int = LEAF_SYMBOLS) -> None:
        self.name, self.limit, self.leaf = name, limit, leaf
        self.tokenizer = load(name)
        self.symbols: Symbols | None = None
        # The split of Latin words is that of the default vocabulary; others go to the library word by word.
        self.pieces = PieceEncoder(name, limit // 2) if name == VOCABULARY else None
        self.memo, self.known = Memo(), Ids()

    def _long(self, word: str) -> list[int]:
        """A long word: the library splits it, and long pieces become trees. Words that hold the
        library's added tokens go to the library whole."""
        if any(t.content in word for t in self.tokenizer.get_added_tokens_decoder().values()):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        self.symbols = self.symbols or Symbols(self.name)
        out: list[int] = []
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word)):
            out += self.symbols.tree(piece, True, self.leaf)[0]
        return out

    def _add(self, words: list[str]) -> None:
        """Plainly Latin words by their pieces, the others by the library; all in the order given."""
        other = np.fromiter((len(w) > self.leaf for w in words), bool, len(words))
        if self.pieces:
            other |= self.pieces.left_out(["" if o else w for w, o in zip(words, other.tolist(), strict=True)])
        else:
            other[:] = True
        lengths = np.zeros(len(words), np.int64)
        plain = [w for w, o in zip(words, other.tolist(), strict=True) if not o]
        ids, lengths[~other] = self.pieces.words(plain) if plain else (np.zeros(0, np.uint32), 0)
        rest = [words[i] for i in np.flatnonzero(other)]
        got = iter(self.tokenizer.encode_batch_fast([w for w in rest if len(w) <= self.leaf], add_special_tokens=False))
        found = [next(got).ids if len(w) <= self.leaf else self._long(w) for w in rest]
        lengths[other] = np.fromiter(map(len, found), np.int64, len(found))
        from_rest = np.repeat(other, lengths)
        out = np.zeros(len(from_rest), np.uint32)
        out[~from_rest] = ids
        out[from_rest] = np.fromiter((i for x in found for i in x), np.uint32)
        self.known.append(out, lengths)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each word has."""
        if len(self.memo) > self.limit:
            self.memo, self.known = Memo(), Ids()
        at = self.memo.numbers(words, len(words))
        if self.memo.fresh:
            fresh, self.memo.fresh = self.memo.fresh, []
            self._add(fresh)
        return self.known.get(at)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each."""
        split = [split_words(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ids, counts = self.words([w for ws in split for w in ws])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)] if len(split) else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)


def encoder(name: str = VOCABULARY, leaf: int = LEAF_SYMBOLS, limit: int = LIMIT) -> WordEncoder:
    """One encoder for each worker process and vocabulary, kept from task to task of the operators that encode."""
    return kept(("encoder", name, leaf, limit), lambda: WordEncoder(name, limit, leaf))
