"""Whitening against one covariance and its eigenvectors; merged states against their rows together."""

import math
import random

import numpy as np
import pytest

from filmloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n long, component int"


def brute(rows, k):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in ok), default=0)
    ok = [(i, x + [0] * (width - len(x))) for i, x in ok]
    fit = np.array(sorted({tuple(x) for _, x in ok}), float).reshape(-1, width)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    e, vecs = np.linalg.eigh((fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n)
    e, vecs = e[::-1], vecs[:, ::-1]
    out = []
    for i, x in ok:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(min(k, width)):
            w = (np.array(x) - np.array(sums) / n) @ vecs[:, c] / math.sqrt(e[c]) if e[c] > 1e-6 else None
            out.append((i, c + 1, n, dev, w, max(e[c], 0) / e.sum()))
    return out


def vectors(n=700, d=9):
    r = np.random.default_rng(3)
    base = r.normal(size=(n, d)) * np.array([5, 4, 3, 2, 1, 1, 0.5, 0.5, 0.1])[:d]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(n + i, base[0].tolist()) for i in range(300)]  # a hot vector counts once
    rows += [(5, base[5].tolist()), (None, base[6].tolist()), (9000, [1.0, -0.0]), (9001, [])]
    return rows + [(9002, None), (9003, [1.0, None] + [0.0] * (d - 2)), (9004, [math.nan] * d), (9005, [math.inf] + [0.0] * (d - 1))]


@pytest.mark.parametrize("k", [4, None])
def test_whiten(spark, k):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in rows], SCHEMA).repartition(11)
    got = wh.whiten(df, components=k).collect()
    want = brute(rows, k or 99)
    key = lambda r: (str(r[0]), r[3], r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    sign = {c: np.sign(sum(g[4] * w[4] for g, w in zip(got, want) if g[1] == c)) for c in {g[1] for g in got}}
    for g, w in zip(got, want):
        assert g[4] * sign[g[1]] == pytest.approx(w[4], abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-9


def test_merges_lose_nothing():
    """A direction a million times weaker than the first survives eleven merges; so do its mean's corrections."""
    r = random.Random(1)
    x = np.array([[r.randrange(-(2**30), 2**30), r.randrange(-100, 100), 7] for _ in range(4000)])
    state = wh.state_of(x[:3])
    for at in range(3, len(x), 400):
        state = wh.merged(state, wh.state_of(x[at : at + 400]))
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert state.n == len(x) and state.sums == x.sum(0).tolist()
    assert np.sqrt((state.scaled**2).sum(1))[:2] == pytest.approx(s[:2], rel=1e-9)


def test_large_sums():
    x = np.full((4, 1), 2**62)
    x[1] = -5
    assert wh.exact_sums(x) == [3 * 2**62 - 5]
    model = wh.Model(4, wh.exact_sums(x), np.ones((1, 1)), np.ones(1), 1.0)
    assert model.deviations(x)[0, 0] == 4 * 2**62 - (3 * 2**62 - 5) and wh.squared(model.deviations(x)) == [None] * 4


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], 1, "", 1, 1), (2, [0.5, 1.0], 1, "", 1, 1)], SCHEMA)
    assert [tuple(r) for r in wh.whiten(df).orderBy("vec_id", "component").collect()] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    assert wh.whiten(df.limit(0)).count() == 0
    assert wh.whiten(df.selectExpr("vec_id AS `my.id`", "embedding AS `the.v`"), "my.id", "the.v").columns[0] == "my.id"
