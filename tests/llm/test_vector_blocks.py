"""Near-duplicate vectors when the lists fail the audit, and entries cut from a hub."""

import numpy as np

from placemetrics.llm import nn_descent


def test_all_are_compared_when_the_audit_fails(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16))
    x[:150] = x[0] + 0.05 * rng.normal(size=(150, 16))
    x[300:303] = x[299]
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (y @ y.T >= 0.9).sum(axis=1) - 1
    monkeypatch.setattr(nn_descent, "descend", lambda graph, *rest: graph.where("u < 30 AND v < 30"))
    monkeypatch.setattr(nn_descent, "ENLARGE", 1)
    monkeypatch.setattr(nn_descent, "SLICE", 100)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(spark, vectors).collect()}
    assert [got[i][0] for i in range(500)] == links.tolist()
    assert all(got[i][1] == 0 for i in range(150)) and all(got[i][1] == 299 for i in range(299, 303))


def test_forest_connects_what_a_block_connects():
    rng = np.random.default_rng(1)
    for _ in range(50):
        near = rng.random((9, 7)) < 0.2

        def groups(links):
            name = list(range(16))
            for i, j in links:
                a, b = name[i], name[9 + j]
                name = [a if k == b else k for k in name]
            return {tuple(i for i in range(16) if name[i] == k) for k in set(name)}

        rows, columns = nn_descent.forest(near)
        assert near[rows, columns].all() and len(rows) < 16
        assert groups(zip(rows, columns)) == groups(np.argwhere(near))


def test_entries_cut_from_a_hub_stay_new(spark):
    graph = spark.createDataFrame([(u, 0, 0.5, True) for u in range(1, 21)], "u long, v long, sim float, new boolean")
    waiting = nn_descent.settled(graph, 12)
    assert waiting.where("new").count() == 8 and waiting.count() == 20
    assert nn_descent.settled(waiting, 12).where("new").count() == 0
