"""Training reads every document, deals every value, and stays good when it is dealt to parts."""

import random

import pandas as pd
import pytest

from placemetrics.llm import secret_scan

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_every_document_is_read(spark, monkeypatch):
    seen, findings = [], secret_scan.findings
    monkeypatch.setattr(secret_scan, "findings", lambda d: seen.append(d.count()) or findings(d))
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat('w', id % 3, ' ', translate(cast(id + 100000000000 AS string), '0123456789', 'abcdefghij'), ' x', id % 2) AS text")
    docs = docs.unionByName(docs.selectExpr("doc_id", "concat('again ', text) AS text"))
    values, parts = secret_scan.dealt(docs, most=2_000)
    assert seen == [18_000] and parts == 5
    rows = values.toPandas()
    assert rows["value"].nunique() == 9_000 and len(rows) == 9_000 and rows.groupby("part").size().max() < 2_500
    assert secret_scan.dealt(docs.limit(0))[1] == 0


def test_parts_learn_together(spark):
    docs = spark.read.parquet(DOCS)
    values, parts = secret_scan.dealt(docs, most=60)
    rows = values.toPandas()
    assert parts == 3 and set(map(tuple, rows[["part", "secret"]].drop_duplicates().to_numpy())) == {(p, s) for p in range(3) for s in (0, 1)}
    net = secret_scan.train(docs, most=60)
    rng = random.Random(8)
    before = [t[:200] for (t,) in docs.where("length(text) > 200").select("text").limit(50).collect()]
    values = ["ghp_" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36)) for _ in before]
    assert sum((len(t) + 1, 3, len(t) + 1 + len(v)) in secret_scan.all_spans(f"{t} {v} and more", net)[1] for t, v in zip(before, values, strict=True)) >= 0.9 * len(before)
    for word in ("internationalisation", "annual-report-2023"):
        assert sum(any(a > len(t) for a, _, _ in secret_scan.all_spans(f"{t} {word} and more", net)[1]) for t in before) <= 2


def test_curve_sums_are_those_of_all_parts():
    z, y = pd.Series([-2.0, -1, 0.5, 1, 3] * 4).to_numpy(), pd.Series([0, 0, 1, 0, 1] * 4).to_numpy()
    nets = [secret_scan.start()[0] for _ in range(2)]
    secret_scan.calibrate(nets[0], lambda a, b: secret_scan.curve_sums(z, y, a, b))
    secret_scan.calibrate(nets[1], lambda a, b: [p + q for p, q in zip(secret_scan.curve_sums(z[:7], y[:7], a, b), secret_scan.curve_sums(z[7:], y[7:], a, b), strict=True)])
    assert nets[0].slope == pytest.approx(nets[1].slope) and nets[0].intercept == pytest.approx(nets[1].intercept)
