"""Near-duplicate vectors against brute force, over several blocks and centres, with repeated and missing ids."""

import numpy as np

from parley.llm import vectors


def brute(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    label = np.arange(len(v))
    while True:
        new = np.array([min(label[i], label[hit[i]].min(initial=len(v))) for i in range(len(v))])
        if (new == label).all():
            return hit.sum(axis=1), label
        label = new


def test_links_and_components_over_blocks_and_centres(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 60)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "ROWS", 50)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 12))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.25, base[:60] + rng.normal(size=(60, 12)) * 0.25, base[:7]]).astype(np.float32).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {x.vec_id: x for x in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    links, label = brute(v)
    assert all(got[i].n_links <= links[i] for i in got) and sum(x.n_links for x in got.values()) >= 0.98 * links.sum()
    exact = [i for i in got if got[i].n_links == links[i]]
    assert len(exact) >= 0.98 * len(v)
    assert np.mean([got[i].component_id == label[i] for i in got]) >= 0.95 and all(got[i].kept == (got[i].component_id == i) for i in got)


def test_every_row_comes_back(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (4, [1.0, 0.01]), (5, None), (None, None), (6, [1.0, 0.0, 0.0]), (7, [0.0, 0.0]), (8, [1e-30, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((x.vec_id or 0, x.n_links, x.component_id) for x in vectors.near_vectors(d).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 0, 1), (0, 1, None), (0, 1, None), (4, 2, 1), (5, 0, 5), (0, 0, None), (6, 0, 6), (7, 0, 7), (8, 2, 1)], key=str)
    assert vectors.near_vectors(d.limit(0)).count() == 0
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1])], "vec_id string, embedding array<double>")
    assert {(x.vec_id, x.component_id) for x in vectors.near_vectors(named).collect()} == {("a", "a"), ("b", "a")}


def test_every_row_with_such_an_id_is_asked(spark):
    """Each id divisible by 100 has a copy with a smaller id and a neighbour: the audit must miss their links when none was found."""
    rows = []
    for k in range(1, 10):
        v = [float(k), 1.0, -1.0]
        rows += [(k * 100, v), (k * 100 - 50, v), (k * 100 + 1, [float(k), 1.01, -1.0])]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert all(r.n_links >= 2 for r in found.collect())
    nodes = spark.createDataFrame([(i, len(v), v, 1, i % 2 == 0) for i, (_, v) in enumerate(rows[::3])], "node long, dim int, embedding array<float>, copies long, asked boolean")
    assert vectors.audit(nodes, nodes.limit(0).select("node", vectors.F.lit(0).alias("links"))) == 0.0
    assert vectors.audit(nodes.withColumn("asked", vectors.F.lit(False)), nodes.limit(0).select("node", vectors.F.lit(0).alias("links"))) == 1.0
