"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

Leaves are clauses of a paragraph (up to and with a closing mark and blank, 64 characters at most);
a paragraph is a line, a section the paragraphs up to a blank line. A node is the SHA-256 of its
children, the root that of the sections, so equal roots mean equal texts. A fingerprint is

    root ":" sections, joined by ";", of paragraphs, joined by ",", of leaves of 8 hex digits

and inner nodes can be made again from it: `differing` walks two fingerprints down only where nodes
differ, and so locates edits. The likeness of two fingerprints is the share of common leaves,
2 * common / all; 1 for equal roots.

Null texts are empty; an empty text is one empty paragraph. In the order of documents rows with a
null doc_id come first and rows of one doc_id follow their texts, so repeated rows are each other's
next. A table of one row is its own next. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm.words import map_frames

CLAUSE = re.compile(r".{1,63}?(?:[.!?;:,|] |\Z)|.{1,64}", re.DOTALL)
SHOWN = 8
ROWS_PER_BUCKET = 20_000


def _sha(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def fingerprint(text: str) -> str:
    roots, shown, section, section_nodes = [], [], [], []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        leaves = [_sha(leaf) for leaf in CLAUSE.findall(line)]
        section.append("".join(x[:SHOWN] for x in leaves))
        section_nodes.append(_sha("".join(leaves)))
        if not line or i == len(lines) - 1:
            shown.append(",".join(section))
            roots.append(_sha("".join(section_nodes)))
            section, section_nodes = [], []
    return f"{_sha(''.join(roots))}:{';'.join(shown)}"


def leaves(mark: str) -> list[str]:
    flat = re.sub("[;,]", "", mark.partition(":")[2])
    return [flat[i:i + SHOWN] for i in range(0, len(flat), SHOWN)]


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = Counter(leaves(a)), Counter(leaves(b))
    total = x.total() + y.total()
    # Unequal texts stay below 1 even where all shown leaves agree.
    return min(2 * (x & y).total() / total, 1 - 1e-9) if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of a that have no equal in the same place of b; sections with equal nodes are not entered."""
    if a == b:
        return []
    x, y = ([s.split(",") for s in m.partition(":")[2].split(";")] for m in (a, b))
    out = []
    for i, own in enumerate(x):
        other = y[i] if i < len(y) else []
        if own != other:
            out += [(i, j) for j, p in enumerate(own) if j >= len(other) or other[j] != p]
    return out


def compare_with_edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last half replaced by the beginning of the next document's. Documents are
    dealt to ranges of doc_id; the first of each range also goes to the range before, as the next of
    that range's last document, and the first of all goes to the last range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = texts.select("doc_id")
    count = ids.count()
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), count // ROWS_PER_BUCKET)
    marks = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if count else None
    about = np.unique(np.array(marks or [], np.int64))

    def place(bounds: np.ndarray, doc_id: pd.Series) -> np.ndarray:
        """Range of each id; null ids belong to the first."""
        return np.where(doc_id.isna(), 0, np.searchsorted(bounds, doc_id.fillna(0).to_numpy(np.int64), side="right"))

    def ranged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"range": place(about, part["doc_id"]), "doc_id": part["doc_id"].astype("Int64")})

    # The real first id of each range, at most one for each; the driver holds only these.
    found = map_frames(ids, ranged, "range int, doc_id long").groupBy("range").agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).collect()
    firsts = sorted((r["range"], r["first"]) for r in found if r["first"] is not None)
    bounds = np.array([x for _, x in (firsts if any(r["nulls"] for r in found) else firsts[1:])], np.int64)
    last = len(bounds)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = part.assign(range=place(bounds, part["doc_id"]), tail=0)
            ahead = own[own["doc_id"].isin(bounds)]
            yield pd.concat([own, ahead.assign(range=ahead["range"] - 1, tail=1)]).astype({"doc_id": "Int64"})

    dealt = map_frames(texts, deal, "doc_id long, text string, range int, tail int")
    first = texts.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1).select("doc_id", "text", F.lit(last).alias("range"), F.lit(2).alias("tail"))
    order = ["range", "tail", F.col("doc_id").asc_nulls_first(), "text"]
    rows = dealt.unionByName(first).repartition("range").sortWithinPartitions(*order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row whose next has not come yet: range, doc_id, text, fingerprint

        for part in parts:
            out = []
            for at, tail, doc_id, text in zip(part["range"], part["tail"], part["doc_id"], part["text"], strict=True):
                mark = None
                if held and held[0] == at:
                    _, name, own, own_mark = held
                    mark = fingerprint(text)
                    half = len(own) // 2
                    edited = own[:len(own) - half] + text[:half]
                    edited_mark = own_mark if edited == own else fingerprint(edited)
                    out.append((name, len(own), _sha(edited), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                held = None if tail else (at, None if pd.isna(doc_id) else int(doc_id), text, mark or fingerprint(text))
            rows = pd.DataFrame([r[1:] for r in out], columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield rows.assign(doc_id=pd.array([r[0] for r in out], "Int64"))

    done = map_frames(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
