"""Near vectors against all pairs: groups of copies, spread groups, pairs at the threshold, and rows that link with nothing."""

import math

import numpy as np
import pytest

from filmloom.llm import nn_descent as nd

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, node long, v int"


def brute(rows, threshold=0.93):
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    for s in {(len(rows[i][1]), rows[i][2]) for i in ok}:
        own = [i for i in ok if (len(rows[i][1]), rows[i][2]) == s]
        u = np.array([[c / max(map(abs, rows[i][1])) for c in rows[i][1]] for i in own])
        u /= np.linalg.norm(u, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1))):
            n[own[a]] += 1
            n[own[b]] += 1
            up[root(own[a])] = root(own[b])
    low: dict = {}
    for i, r in enumerate(rows):
        c = root(i)
        low[c] = min((x for x in (low.get(c), r[0]) if x is not None), default=None)
    return [(r[0], n[i], low[root(i)], r[0] == low[root(i)]) for i, r in enumerate(rows)]


def vectors(d=24):
    g = np.random.default_rng(8)
    base = g.normal(size=(900, d))
    out = [v / np.linalg.norm(v) for v in base]
    for i in range(150):  # at angles about the threshold's
        w = g.normal(size=d)
        w -= out[i] * (w @ out[i])
        a = g.uniform(0.25, 0.42)
        out.append(math.cos(a) * out[i] + math.sin(a) * w / np.linalg.norm(w))
    tight = out[1] + g.normal(size=(300, d)) * 0.01
    spread = out[2] + g.normal(size=(250, d)) * 0.055  # some pairs link, some do not
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(out)]
    rows += [(2000 + i, v.tolist(), 1) for i, v in enumerate([*tight, *spread])]
    rows += [(4000 + i, (v * 3).tolist(), 2) for i, v in enumerate(out[3:9])] + [(5000 + i, out[4].tolist(), 0) for i in range(500)]
    rows += [(7, out[7].tolist(), 1), (7, out[7].tolist(), 1), (None, out[5].tolist(), 2), (None, (np.eye(d)[0] + 5).tolist(), 8)]
    rows += [(9000, None, 1), (9001, [0.0] * d, 1), (9002, [math.nan] * d, 1), (9003, [None] * d, 1), (9004, out[1].tolist(), None), (9005, [math.inf] * d, 1)]
    return rows + [(9006, [1.0, 2.0], 1), (9007, [1.01, 2.0], 1), (9008, [1e-200, 2e-200], 1), (9009, [], 1), (9010, [-1.0, -2.0], 1)]


def test_near_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(7)
    got = sorted(map(tuple, nd.near_vectors(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    assert sum(g != w for g, w in zip(got, want)) <= 3


def test_dense_group_makes_no_pairs(spark):
    """Copies of one vector, each a little off, become balls: few centres are left to pair."""
    g = np.random.default_rng(1)
    v = g.normal(size=16)
    rows = [(i, f"16:{i % 2}", (v + g.normal(size=16) * 0.01).tolist(), 1) for i in range(3000)]
    classes = spark.createDataFrame(rows, "node long, space string, v array<double>, n long")
    member, centres = nd.Search(0.93).balls(classes)
    assert centres.count() <= 8 and member.count() == 3000
    radius = {r["node"]: r["radius"] for r in centres.collect()}
    at = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows}
    assert all(math.acos(min(1, at[r["node"]] @ at[r["centre"]])) <= radius[r["centre"]] + 1e-9 for r in member.collect())


def test_saturated_lists_grow(spark):
    rows = [(1, b, 0.99 - b / 1000, True, 3, True) for b in range(2, 9)] + [(9, b, 0.5, b == 2, 3, True) for b in range(2, 9)]
    edges = spark.createDataFrame(rows, "a long, b long, sim double, near boolean, k int, fresh boolean")
    got = nd.Search.lists(edges, 3).orderBy("a", "b").collect()
    assert [(r["a"], r["b"], r["k"], r["bar"]) for r in got] == [(1, 2, 6, -2.0), (1, 3, 6, -2.0), (1, 4, 6, -2.0), (9, 2, 3, 0.5), (9, 3, 3, 0.5), (9, 4, 3, 0.5)]


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(3, [1.0, 0.0], 1)], "`my.id` long, v array<double>, `the label` int").limit(n)
    assert [tuple(r) for r in nd.near_vectors(df, "my.id", "v", "the label").collect()] == [(3, 0, 3, True)] * n
