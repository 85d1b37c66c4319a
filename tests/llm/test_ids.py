"""Large ids next to nulls in one batch come back as they are, from every operator that carries them."""

import pytest

from placemetrics.llm import bpe, codec, jaccard_join, langid, merkle, packing, quality, runs, secret_scan, token_counts, toxicity

IDS = [2 ** 60 + 1, None, 2 ** 60 + 2, 2 ** 60 + 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words of the text number {k} and more of them", "en") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(IDS)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "jaccard": lambda spark, d, y: jaccard_join.jaccard_components(spark, d),
    "toxicity": lambda spark, d, y: toxicity.score(d, toxicity.train(d, y)),
    "counts": lambda spark, d, y: token_counts.count_tokens(d),
    "cut points": lambda spark, d, y: token_counts.cut_points(d, 3),
    "language": lambda spark, d, y: langid.predict(d, langid.train(d)),
    "fingerprints": lambda spark, d, y: merkle.compare_with_edits(spark, d),
    "quality": lambda spark, d, y: quality.score(d, quality.train(d, y)),
    "secrets": lambda spark, d, y: secret_scan.scan(d, secret_scan.train(d)),
    "codec": lambda spark, d, y: codec.encode_digests(d),
    "codec of leaves": lambda spark, d, y: codec.decode(codec.encode(d, leaf=10)),
    "packing": lambda spark, d, y: packing.pack(spark, d),
    "runs": lambda spark, d, y: runs.find_runs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay(spark, docs, labels, name):
    got = [r.doc_id for r in OPERATORS[name](spark, docs, labels).collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)


def test_long_clean_text_is_scored_as_fitted():
    import numpy as np
    weights = np.zeros(1 << toxicity.BITS)
    words = [f"abcdef{k}" for k in range(200)]
    shared = set.intersection(*(set(f) for f in toxicity.features_of(words).tolist()))
    weights[sorted(shared)] = 0.5
    scorer = toxicity.Scorer(toxicity.Ordinal(weights, np.array([2.0, 4.0])))
    p = scorer.above([" ".join(words[:n]) for n in (1, 3, 10, 200)])[:, 0]
    assert p[0] < p[1] == p[2] == p[3]


def test_plain_words_are_those_of_the_library():
    import random
    rng = random.Random(3)
    library, enc = bpe.load(bpe.VOCABULARY), bpe.WordEncoder(limit=500)
    signs = "abzAZéÉçß'’-_.,!<|>0123²½ıİŁłſ　中日ΣΑª\x85\xa0\x1c\t\x0b$€ʼŉǅȺst"
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    for at in range(0, 4000, 50):
        text = " ".join(words[at:at + 50])
        assert enc.texts([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_one_id_on_different_texts(spark):
    """The clean text of a repeated id stays; of its near copy of another id the first id's row stays."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(7, a), (7, b), (7, a), (9, b + " more"), (9, "c d e f g h"), (3, ""), (3, ""), (3, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(spark, docs).collect()), key=str)
    assert [x for x in got if x[0] != 3] == sorted([(7, a), (7, b), (9, "c d e f g h"), (None, a)], key=str)
    assert len([x for x in got if x[0] == 3]) == 1
