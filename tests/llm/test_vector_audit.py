"""The audit of near-duplicate vectors counts what the lists miss."""

import numpy as np

from placemetrics.llm import nn_descent


def group_of_near_copies(n, inside):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 16))
    x[:inside] = x[0] + 0.05 * rng.normal(size=(inside, 16))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, (y @ y.T >= 0.9).sum(axis=1) - 1


def test_vectors_outside_their_dense_group_are_missed(spark, monkeypatch):
    x, links = group_of_near_copies(900, 300)
    descend, turns = nn_descent.descend, []

    def poor_at_first(graph, *rest):
        graph = descend(graph, *rest)
        turns.append(1)
        return graph.where("u NOT BETWEEN 200 AND 299 AND v NOT BETWEEN 200 AND 299") if len(turns) == 1 else graph

    monkeypatch.setattr(nn_descent, "descend", poor_at_first)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(spark, vectors).collect()}
    assert len(turns) > 1
    assert [got[i][0] for i in range(900)] == links.tolist() and all(got[i][1] == 0 for i in range(300))


def test_recall_counts_pairs_of_one_dense_component_of_the_lists(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    listed = pairs([(0, 1), (1, 2), (7, 8)])
    full = spark.createDataFrame([(1,)], "point long")
    assert nn_descent.recall_of(pairs([(0, 1), (0, 2)]), listed, full) == 1  # enlarging finds the second
    assert nn_descent.recall_of(pairs([(0, 1), (0, 2), (2, 9), (0, 9)]), listed, full) == 0.5
    assert nn_descent.recall_of(pairs([(7, 8), (2, 7)]), listed, full) == 0.5


def test_a_sample_without_links_grows_until_it_tells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16))
    x[390:] = x[380:390] + 0.01 * rng.normal(size=(10, 16))  # ten pairs among 400 vectors
    monkeypatch.setattr(nn_descent, "AUDIT", 4)
    sizes, audit = [], nn_descent.audit
    monkeypatch.setattr(nn_descent, "audit", lambda found, threshold, most: sizes.append(most) or audit(found, threshold, most))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = nn_descent.points(vectors)[0]
    assert nn_descent.telling_audit(found, 0.9, 400).count() == 10 and sizes == [4, 16, 64, 256, 1024]
    monkeypatch.setattr(nn_descent, "LINKED", 2)
    assert nn_descent.telling_audit(found, 0.9, 400) is not None and max(sizes[5:]) < 1024
    # Where even the largest sample cannot tell, all are compared; the rounds are not even begun.
    monkeypatch.setattr(nn_descent, "LINKED", 64)
    monkeypatch.setattr(nn_descent, "AUDIT_MOST", 16)
    monkeypatch.setattr(nn_descent, "descend", None)
    rows, recall = nn_descent.near_duplicates_and_recall(spark, vectors)
    got = {r.vec_id: r for r in rows.collect()}
    assert recall == 1 and all(got[i].n_links == (i >= 380) and got[i].component_id == (i - 10 if i >= 390 else i) for i in range(400))
