"""Language models keep every 4-gram counted, however large the corpus."""

import numpy as np
from pyspark.sql import functions as F

from placemetrics.llm import langid


def test_rare_grams_stay(spark):
    common, rare = "abab abba " * 20_000, "zebra quick zebra"
    docs = spark.createDataFrame([(k, common, "en") for k in range(10)] + [(10, rare, "en"), (11, "der hund", "de")], "doc_id long, text string, lang string")
    packed = np.concatenate([langid.grams((common * 10).split())[0], langid.grams(rare.split())[0]])
    assert len(packed) > 1_000_000
    keys, counts = np.unique(packed, return_counts=True)
    got = {r.gram: r.n for r in langid.gram_counts(docs).where("lang = 'en'").collect()}
    assert got == dict(zip(keys.tolist(), counts.tolist(), strict=True))
    models = langid.train(docs)
    assert models.names == ["de", "en"]
    whole = langid.KneserNey(keys, counts)
    for have, want in zip(models.models[1].levels, whole.levels, strict=True):
        assert np.array_equal(have.keys, want.keys) and np.allclose(have.share, want.share) and np.allclose(have.down, want.down)


def test_the_calibrating_fold_is_not_in_the_models_that_score_it(spark, monkeypatch):
    words = {"en": ["the", "house", "with", "water"], "de": ["das", "haus", "mit", "wasser"]}
    docs = spark.createDataFrame([(i, " ".join(words[lang][(i + k * k) % 4] for k in range(3 + i % 5)) + f" {'x' * (i % 7)}", lang) for i in range(200) for lang in ("en", "de")], "doc_id long, text string, lang string")
    seen, calibrate = [], langid.Models.calibrate
    monkeypatch.setattr(langid.Models, "calibrate", lambda self, texts, langs: seen.append((self, sorted(texts))) or calibrate(self, texts, langs))
    models = langid.train(docs)
    (apart, texts), = seen
    fold = docs.where(langid.calibrates())
    assert texts == sorted(r.text for r in fold.collect()) and 0 < len(texts) < 400
    for part, have in ((docs.where(~langid.calibrates()), apart), (docs, models)):
        counts = langid.gram_counts(part.where(F.col("lang") == "en")).toPandas().sort_values("gram")
        want = langid.KneserNey(counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
        assert all(np.array_equal(a.keys, b.keys) and np.allclose(a.share, b.share) for a, b in zip(have.models[1].levels, want.levels, strict=True))
    assert (models.slope, models.intercept, models.reject_under) == (apart.slope, apart.intercept, apart.reject_under)


def test_scripts_beyond_the_basic_plane_differ():
    gothic, deseret = "\U00010330\U00010331\U00010332", "\U00010428\U00010429\U0001042a"
    assert len(set(langid.grams([gothic, deseret])[0].tolist())) == 8
    assert not set(langid.grams([gothic])[0].tolist()) & set(langid.grams([deseret, "abc"])[0].tolist())
