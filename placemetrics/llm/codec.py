"""Encoding and decoding of whole texts by tree concatenation.

A text of more than `leaf` characters is cut at fixed places into leaves, which tasks encode in
parallel, whatever they cut through. Leaves are then joined in pairs, pairs of pairs, and so on. At
each join a window of words on both sides is encoded anew and doubles until its outermost words have
the ids that both sides gave them; a side that runs out goes into the window whole. Unsplit
stretches inside a word are joined the same way token by token (`bpe.Symbols.tree`).

Null texts are empty (no ids, empty decoded text). Repeated rows give a row each. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.llm.bpe import VOCABULARY, WordEncoder, encoder, split_words
from placemetrics.llm.words import batches, thrifty
from placemetrics.llm.words import pieces as slices

LEAF_CHARS = 16_384
#: Words a task remembers here.
MEMO = 250_000


@dataclass
class Part:
    """An encoded stretch: its words, how many ids each has, and all ids."""

    words: list[str]
    counts: np.ndarray
    ids: np.ndarray


def leaf_part(enc: WordEncoder, text: str) -> Part:
    words = split_words(text)
    ids, counts = enc.words(words)
    return Part(words, counts, ids)


def join(enc: WordEncoder, a: Part, b: Part) -> Part:
    """Exact encoding of a's text followed by b's."""
    width = 2
    while True:
        left, right = a.words[-width:], b.words[:width]
        window = [*left[:-1], left[-1] + right[0], *right[1:]]
        ids, counts = enc.words(window)
        n_left, n_right = int(a.counts[-width:].sum()), int(b.counts[:width].sum())
        first, last = int(counts[0]), int(counts[-1])
        mine = a.ids[len(a.ids) - n_left:][:int(a.counts[-len(left)])]
        other = b.ids[:n_right][n_right - int(b.counts[len(right) - 1]):]
        on_left = len(left) == len(a.words) or (len(left) > 1 and np.array_equal(ids[:first], mine))
        on_right = len(right) == len(b.words) or (len(right) > 1 and np.array_equal(ids[len(ids) - last:], other))
        if on_left and on_right:
            return Part(a.words[:-width] + window + b.words[width:], np.concatenate([a.counts[:-width], counts, b.counts[width:]]),
                        np.concatenate([a.ids[:len(a.ids) - n_left], ids, b.ids[n_right:]]))
        width *= 2


def join_all(enc: WordEncoder, parts: list[Part]) -> Part:
    while len(parts) > 1:
        parts = [join(enc, *parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS, then: Callable[[list[bytes]], list[pa.Array]] | None = None,
           schema: str = "ids binary") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers, as binary) of every row.

    `then` turns the ids of some texts into other columns (those of `schema`) in the task that encoded
    them. Ids of documents pass as Arrow columns, so large ones next to nulls stay as they are.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    then = then or (lambda ids: [pa.array(ids, pa.binary())])
    names = ["doc_id", *(c.split()[0] for c in schema.split(","))]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, limit=MEMO)
        for part in slices(parts):
            rows, doc_ids = part.column("text").to_pylist(), part.column("doc_id")
            for s in batches(rows):
                ids, counts = enc.texts(rows[s])
                cuts = np.concatenate([[0], np.cumsum(counts)])
                made = then([ids[i:j].astype("<u4").tobytes() for i, j in zip(cuts, cuts[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(s.start, s.stop - s.start), *made], names)

    short = texts.where(F.length("text") <= leaf).mapInArrow(thrifty(whole, keeps=True), f"doc_id {kind}, {schema}")

    def cut_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, 1):
            text = part.column("text")[0].as_py()
            n = -(-len(text) // leaf)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array([0] * n)), pa.array([text[k * leaf:(k + 1) * leaf] for k in range(n)]),
                                              part.column("row").take(pa.array([0] * n)), pa.array([len(text)] * n, pa.int64()), pa.array(range(n), pa.int32())],
                                             ["doc_id", "text", "row", "size", "leaf"])

    # Rows are told apart by content: equal rows share their leaves, each then standing once per copy.
    long = texts.where(F.length("text") > leaf).withColumn("row", F.xxhash64("doc_id", "text", F.lit("row")))
    spread = long.mapInArrow(thrifty(cut_up, keeps=True), f"doc_id {kind}, text string, row long, size long, leaf int").repartition(F.xxhash64("row", "leaf"))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, limit=MEMO)
        for part in slices(parts):
            got = [leaf_part(enc, t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.ids.astype("<u4").tobytes() for p in got], pa.binary()), pa.array([p.counts.astype("<u4").tobytes() for p in got], pa.binary())],
                                             [*part.schema.names, "ids", "counts"])

    encoded = spread.mapInArrow(thrifty(each, keeps=True), spread.schema.simpleString()[7:-1] + ", ids binary, counts binary")

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, limit=MEMO)
        key, doc_id, held, copies, last = None, None, [], 0, -1

        def done() -> pa.RecordBatch:
            made = then([join_all(enc, held).ids.astype("<u4").tobytes()])
            return pa.RecordBatch.from_arrays([c.take(pa.array([0] * copies)) for c in (doc_id, *made)], names)

        for part in slices(parts):
            columns = (part.column(c).to_pylist() for c in ("row", "size", "leaf", "text", "ids", "counts"))
            for k, (row, size, number, text, ids, counts) in enumerate(zip(*columns, strict=True)):
                if (row, size) != key:
                    if held:
                        yield done()
                    key, doc_id, held, copies, last = (row, size), part.column("doc_id").slice(k, 1), [], 0, -1
                copies += number == 0
                if number != last:
                    held.append(Part(split_words(text), np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(ids, "<u4")))
                    last = number
        if held:
            yield done()

    whole_again = encoded.repartition("row", "size").sortWithinPartitions("row", "size", "leaf").mapInArrow(thrifty(joined, keeps=True), f"doc_id {kind}, {schema}")
    return short.unionByName(whole_again)


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; the text is decoded from the ids.

    A vocabulary without a decoder decodes to its tokens with a blank between them, which is done here
    by table; one with a decoder is left to the library.
    """
    made: dict[str, list[str]] = {}

    def then(rows: list[bytes]) -> list[pa.Array]:
        tokenizer = encoder(vocabulary, limit=MEMO).tokenizer
        if not made:
            made["tokens"] = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
            made["numbers"] = [str(i) for i in range(len(made["tokens"]))]
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        out = []
        for packed in rows:  # one text at a time: its ids as Python numbers take many times their bytes
            ids = np.frombuffer(packed, "<u4").tolist()
            text = " ".join(map(made["tokens"].__getitem__, ids)) if tokenizer.decoder is None else tokenizer.decode(ids, skip_special_tokens=False)
            out.append((len(ids), sha(" ".join(map(made["numbers"].__getitem__, ids))), sha(text)))
        counts, numbers, texts = zip(*out, strict=True) if out else ((), (), ())
        return [pa.array(counts, pa.int64()), pa.array(numbers, pa.string()), pa.array(texts, pa.string())]

    return encode(docs, vocabulary, leaf, then, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of encoded rows, as the library decodes them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary).tokenizer
        for part in slices(parts):
            texts = [tokenizer.decode(np.frombuffer(b, "<u4").tolist(), skip_special_tokens=False) for b in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(thrifty(run, keeps=True), f"doc_id {kind}, text string")
