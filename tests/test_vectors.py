"""Clusters, assignments, choices and windows over ranges against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.operators import choice, cluster, ranges, segments


def density_clusters(vectors, eps, least):
    """id -> (cluster, is core), each vector tried in order of id as the textbook does."""
    ids = sorted(vectors)
    u = {i: np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in ids}
    near = {i: [j for j in ids if u[i] @ u[j] >= 1 - eps * eps / 2] for i in ids}
    out, n = {}, 0
    for i in ids:
        if i in out or len(near[i]) < least:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = (n, len(near[j]) >= least)
                todo += near[j] if out[j][1] else []
        n += 1
    return {i: out.get(i, (-1, False)) for i in ids}


@pytest.mark.parametrize("block", [4, 512])
def test_dbscan(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    g, rows = np.random.default_rng(2), []
    for label in (0, 1):
        centres = g.normal(size=(5, 6)) * 2
        rows += [(label * 1000 + i, (centres[i % 5] + g.normal(size=6) * (0.35 if i % 5 else 0.7)).tolist(), label) for i in range(90)]
    odd = [(5000, [0.0] * 6, 0), (5001, None, 0), (5002, rows[0][1], None), (5003, [1.0], 1), (5004, [], 1)]
    got = cluster.dbscan(spark.createDataFrame(rows + odd, "vec_id long, v array<double>, label int"), "vec_id", "v", "label", 0.4, 4).collect()
    want = {i: (-1, False) for i, *_ in odd}
    for label in (0, 1):
        want |= density_clusters({i: v for i, v, x in rows if x == label}, 0.4, 4)
    assert {r["vec_id"]: (r["cluster"], r["is_core"]) for r in got} == want and len(got) == len(want)
    assert {c for c, _ in want.values()} >= {-1, 0, 1, 2} and any(c >= 0 and not core for c, core in want.values())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in cluster.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {499: 499, 500: 499}


def in_turn(pairs):
    out, taken = {}, set()
    for i in sorted({p[0] for p in pairs}):
        best = min(((-s, j) for k, j, s in pairs if k == i and j not in taken and s is not None and s > -1), default=None)
        if best:
            taken.add(best[1])
            out[i] = best[1]
    return out


@pytest.mark.parametrize("alone", [0, 60, 10_000])
def test_assign(spark, alone):
    r, rows, want = random.Random(4), [], {}
    for g in ("a", "b", "c", None):
        n, m = r.choice([(9, 5), (7, 12), (3, 3)])
        pairs = [(i, j, r.choice([0.1, 0.5, 0.5, 0.9, -1.0, None])) for i in range(n) for j in range(m) if r.random() < 0.8]
        rows += [(g, *p) for p in pairs]
        want |= {(g, i): j for i, j in in_turn(pairs).items()}
    got = choice.assign(spark.createDataFrame(rows, "g string, i int, j int, s double"), "g", "i", "j", "s", alone).collect()
    assert {(x["g"], x["i"]): x["j"] for x in got} == want and len(got) == len(want)


def test_assign_rounds_end(spark):
    """All want the same: as many rounds as there are rights; none is asked twice."""
    rows = [(0, i, j, 1.0 - j / 100) for i in range(6) for j in range(5)]
    got = choice.assign(spark.createDataFrame(rows, "g int, i int, j int, s double"), "g", "i", "j", "s", 0).collect()
    assert {x["i"]: x["j"] for x in got} == {i: i for i in range(5)}


def covered(v, rel, t, most, w=(0.5, 0.3, 0.2)):
    n = len(v)
    if n <= most:
        return list(range(n))
    chosen = [max(range(n), key=lambda i: (rel[i], -i))]
    while len(chosen) < most:
        rest = [i for i in range(n) if i not in chosen]
        rest = rest[:: len(rest) // 100] if len(rest) > 100 else rest

        def value(c):
            sims = [float(np.dot(v[s], v[c])) for s in chosen]
            away = min(abs(t[s] - t[c]) for s in chosen) / (max(t) - min(t) + 1e-8)
            return w[0] * rel[c] + w[1] * (1 - max(sims)) + w[2] * (0.7 * (1 - sum(sims) / len(sims)) + 0.3 * away)

        chosen.append(max(rest, key=lambda c: (value(c), -c)))
    return chosen


def test_cover(spark):
    g, rows, want = np.random.default_rng(6), [], {}
    for label, n in (("few", 8), ("some", 90), ("many", 1500)):
        v = g.normal(size=(n, 5)) / 3
        rel = np.round(g.random(n), 2)
        rows += [(label, i, v[i].tolist(), float(rel[i]), float(i * 2), "x") for i in range(n)]
        want |= {(label, p): k for k, p in enumerate(covered(v, rel, [i * 2.0 for i in range(n)], 12))}
    df = spark.createDataFrame(rows, "g string, place long, v array<double>, r double, t double, other string")
    got = choice.cover(df, "g", "place", "v", "r", "t", most=12).collect()
    assert {(x["g"], x["place"]): x["chosen"] for x in got} == want and len(got) == len(want)


def test_ranges_of_one_hot_key(spark):
    """A key with all rows is cut into ranges; windows, sums and percentiles are those of the whole key."""
    r = random.Random(9)
    rows = [("k" if i else None, r.randrange(10**6), float(r.randrange(50))) for i in range(3000)]
    df = ranges.placed(spark.createDataFrame(rows, "k string, o long, x double"), "k", "o")
    own = sorted((o, x) for k, o, x in rows if k)
    got = df.where("k = 'k'").orderBy("place").collect()
    assert [(g["place"], g["o"]) for g in got] == [(i, o) for i, (o, _) in enumerate(own)]
    add = lambda w: {"m": F.sum("x").over(w.rowsBetween(-2, 3)), "last": F.lag("x", 2).over(w)}
    got = ranges.running_sum(ranges.over_ranges(df, "k", "place", 2, 3, add, 100), "k", "place", F.col("x"), "run", 100).where("k = 'k'").orderBy("place").collect()
    xs = [g["x"] for g in got]
    assert [g["m"] for g in got] == [sum(xs[max(0, i - 2) : i + 4]) for i in range(len(xs))]
    assert [g["last"] for g in got] == [None, None, *xs[:-2]] and [g["run"] for g in got] == np.cumsum(xs).tolist()
    assert {x["k"]: x["p"] for x in ranges.percentile(df, "k", "x", 0.15, "p").collect()}["k"] == pytest.approx(np.percentile(xs, 15))


def bounds(v, window=5, share=15, least=3, longest=30):
    n = len(v)
    sims = [round(float(np.dot(a, b)), 6) for a, b in zip(v, v[1:])]
    cuts = []
    if len(sims) > window:
        change = [(sims[i + window] - sims[i]) / window for i in range(len(sims) - window)]
        low, last = np.percentile(change, share), -least
        for c in [i for i, x in enumerate(change) if x < low]:
            if c - last >= least:
                cuts.append(c + 1)
                last = c
    out = []
    for a, b in zip([0, *cuts], [*cuts, n]):
        if b - a < least and out:
            out[-1] = (out[-1][0], b)
        else:
            k = (b - a - 1) // longest + 1
            out += [(a + i * ((b - a) // k), a + (i + 1) * ((b - a) // k) if i < k - 1 else b) for i in range(k)]
    return out


@pytest.mark.parametrize(("n", "size"), [(1, 10), (4, 10), (203, 10), (203, 8192), (150, 7)])
def test_segments(spark, monkeypatch, n, size):
    monkeypatch.setattr(ranges, "SIZE", size)
    g = np.random.default_rng(n)
    v = np.cumsum(g.normal(size=(n, 4)) * np.where(np.arange(n)[:, None] % 60 < 50, 0.05, 1), 0)
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([("k", i, x.tolist()) for i, x in enumerate(v)], "k string, place long, v array<double>")
    cuts = segments.density_boundaries(segments.neighbour_similarity(df, "k", "place", "v"), "k", "place", "sim")
    got = [tuple(r)[1:] for r in segments.segment_similarity(cuts, df, "k", "place", "v").orderBy("start").collect()]
    assert [r[:2] for r in got] == bounds(v)
    for a, b, sim in got:
        each = [float(np.dot(v[i], v[j])) for i in range(a, b) for j in range(i + 1, min(i + 5, b))]
        assert sim == pytest.approx(sum(each) / len(each) if each else 1.0)
    merged = {r["place"]: r["merged"] for r in segments.nearby_mean(df, "k", "place", "v").collect()}
    assert all(merged[i] == pytest.approx(v[max(0, i - 1) : i + 2].mean(0).tolist()) for i in range(n))


def test_blocks_of_a_large_group_are_few(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 4)
    g = np.random.default_rng(6)
    rows = [(i, g.normal(size=6).tolist(), int(i >= 1200)) for i in range(1600)]
    got = cluster._blocks(spark.createDataFrame(rows, "_id long, u array<double>, label int"), "label").collect()
    assert sorted(i for r in got for i in r["ids"]) == list(range(1600))
    assert all(16 <= sum(r["_g"] == k for r in got) <= 32 for k in (0, 1))
