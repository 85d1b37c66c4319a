"""Whitening against whole-number arithmetic over all rows at once."""

import numpy as np
import pytest

from placemetrics.llm import whitening

ROWS = "vec_id long, embedding array<float>, n int, component string"


@pytest.mark.parametrize("scale, rows", [(1.0, 700), (1e4, 130), (1e9, 64), (1e15, 9)])
def test_scatter_is_exact(scale, rows):
    rng = np.random.default_rng(3)
    z = np.floor(scale * rng.normal(size=(rows, 5))).astype(np.int64)
    z[:, 2] = 7
    own = [[*map(int, r), 1] for r in z]
    want = [[sum(r[a] * r[b] for r in own) for b in range(6)] for a in range(6)]
    assert whitening.scatter(z).tolist() == want


def whole(rows, size):
    good = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    return [i for i, _ in good], [[int(np.floor(64 * float(np.float32(x)))) + 1_000_000 for x in v] for _, v in good]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whiten(spark, kind):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) * 0.1).astype(np.float32)
    rows = [(2 ** 60 + k, v.tolist()) for k, v in enumerate(x)] + [(5, x[0].tolist()), (5, x[0].tolist()), (None, x[1].tolist())]
    bad = [(900, None), (901, [float("nan")] * 40), (902, [None] * 40), (903, [1.0] * 3), (904, [float("inf")] * 40), (905, [])]
    table = spark.createDataFrame([(*r, 1, "c") for r in rows + bad], ROWS.replace("float", kind)).repartition(3)
    got = whitening.whiten(spark, table).collect()
    ids, xs = whole(rows, 40)
    n = len(ids)
    sums = [sum(c) for c in zip(*xs, strict=True)]
    cov = np.array([[(n * sum(r[a] * r[b] for r in xs) - sums[a] * sums[b]) / n ** 2 for b in range(40)] for a in range(40)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = {}
    for i, r in zip(ids, xs, strict=True):
        far = [n * v - s for v, s in zip(r, sums, strict=True)]
        want.setdefault(i, []).append((sum(f * f for f in far), np.array(far) / n @ axes[:, :32] / np.sqrt(values[:32])))
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        options = want[r.vec_id]
        assert int(r.deviation) in {d for d, _ in options}
        w = options[0][1][r.component - 1]
        if abs(w) > 1e-3:
            signs.setdefault(r.component, set()).add(round(r.whitened / w, 6))
        assert abs(r.explained / (values[r.component - 1] / cov.trace()) - 1) < 1e-9
        assert r.identity_error < 1e-9
    assert all(len(s) == 1 and abs(next(iter(s))) == 1 for s in signs.values())


def test_degenerate(spark):
    empty = spark.createDataFrame([], ROWS)
    same = spark.createDataFrame([(k, [0.25, 1.0, -3.0], 1, "c") for k in range(5)], ROWS)
    assert whitening.whiten(spark, empty).count() == whitening.whiten(spark, same).count() == 0
    wide = spark.createDataFrame([(1, [3e38, 0.0], 1, "c"), (2, [-3e38, 0.0], 1, "c"), (3, [1.0, 0.0], 1, "c")], ROWS)
    got = whitening.whiten(spark, wide).collect()
    assert len(got) == 3 and {r.component for r in got} == {1}
