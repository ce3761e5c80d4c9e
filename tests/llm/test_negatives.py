"""Hard negatives against every pair, and the tree's bounds."""

import math
import random

import duckdb
import numpy as np
import pytest

from parley.llm import negatives, queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    good = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(good):
        if i is None or i % 100:
            continue
        scored = [(-max(-negatives.LONG, min(negatives.LONG, sum(x * y for x, y in zip(v, w, strict=True)))), j is None, j or 0, other, j) for b, (j, other, w) in enumerate(good) if b != a and len(w) == len(v)]
        scored.sort(key=lambda x: x[:3])
        for p in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]][:10]
            out += [(i, p[4], n, x[4], -p[0], -x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, node long, v string")


def check(spark, rows):
    return sorted(map(tuple, negatives.from_embeddings(table(spark, rows)).collect()), key=repr) == plain(rows)


def test_given_table(spark):
    rows = duckdb.execute(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    got = queries.op13_hard_negatives(spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({queries.ORACLE_SQL['op13_hard_negatives']})").fetchall(), key=repr) == plain(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None), (200, [], 1), (6, [], 2), (300, [0.0, 0.0], 2), (8, [1.0, 2.0, 3.0], 2), (400, [1.0, 2.0, 2.5], 3)]
    rows += [(None, [0.5, 0.25], 2), (None, [0.5, 0.25], 2)] + [(i, [0.6, 0.2], 2 + i % 3) for i in range(20, 60)] + [(i, [-0.6, -0.2], 1) for i in range(60, 65)]
    assert check(spark, rows)
    assert negatives.from_embeddings(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e7])
def test_large_components(spark, size):
    """Inner products up to 1e17 and 1e19: beyond exact doubles, and at last beyond longs."""
    r = random.Random(4)
    assert check(spark, [(i * 50, [float(np.float32(r.choice([-1, 1]) * r.random() * size)) for _ in range(4)], r.randrange(3)) for i in range(60)])


def test_many_shards_and_a_hot_copy(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", 60)
    monkeypatch.setattr(negatives, "FIRST", 1)
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(900):
        c = r.randrange(8)
        rows.append((i, [1.0, 0.0, 0.5, 0.0, 0.25, 0.0] if i % 3 == 0 else [x + r.gauss(0, 0.2) for x in base[c]], c))
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert check(spark, rows)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    v = rng.integers(-300, 300, (700, 12))
    label, largest = rng.integers(0, 4, 700), float((v.astype(float) ** 2).sum(axis=1).max())
    t = negatives.cover_tree(v, label, np.arange(700), np.arange(700), largest)
    assert sorted(t.node.tolist()) == list(range(700))
    for q in rng.integers(-300, 300, (20, 12)).astype(float):
        low, high = negatives.bounds(q, t.v[t.centre].astype(float), t.radius, largest)
        for i in range(len(t.radius)):
            s = t.v[t.start[i] : t.stop[i]] @ q
            assert low[i] <= s.min() and s.max() <= high[i]
            if t.child[i] >= 0:
                c = slice(t.child[i], t.child[i] + t.children[i])
                assert t.start[c].min() == t.start[i] and t.stop[c].max() == t.stop[i] and (t.stop - t.start)[c].sum() == t.stop[i] - t.start[i]
            if t.only[i] >= 0:
                assert set(t.label[t.start[i] : t.stop[i]]) == {t.only[i]}


def test_many_queries_share_a_descent(monkeypatch):
    """The same results, in the same order, as one descent a query."""
    monkeypatch.setattr(negatives, "WAITING", 500)
    rng = np.random.default_rng(7)
    v = rng.integers(-20, 20, (1500, 6))
    label, largest = rng.integers(0, 4, 1500), float((v.astype(float) ** 2).sum(axis=1).max())
    s = negatives.Searcher(negatives.cover_tree(v, label, np.arange(1500), np.arange(1500)[::-1].copy(), largest))
    q, own, same = v[:200].astype(float), np.arange(200), np.arange(200) % 2 == 0
    low, high = rng.integers(-500, 200, (200, 3)), rng.integers(0, 900, (200, 3))
    low[::5], high[::5] = -negatives.LONG - 1, negatives.LONG
    low[1::5, 2], high[1::5, 2] = negatives.LONG, -negatives.LONG
    plain = [(i, w, place, -score) for i in range(200) for w, best in enumerate(s.descend(v[i], label[i], same[i], low[i], high[i], 4, own[i])) for score, _, place in best]
    got = s.descend_all(q, label[:200], same, low, high, 4, own)
    assert s.exact(q).all() and len(plain) > 1000
    assert list(zip(*(x.astype(int).tolist() for x in got), strict=True)) == plain
