"""Anchors against difflib on every window of every track, and the pieces that are searched for."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from filmloom.functions import fuzzy
from filmloom.operators import anchors

VOCAB = [f"{a}{b}" for a in ("ba", "ro", "ti", "ku", "mel") for b in ("ran", "so", "lith", "ow", "um", "dea", "ng")]


def bare(t):
    return re.sub(r"[^\w\s]", "", t.lower()).strip()


def spoken(texts, track, prefer_end, lo=0.0, hi=1e9):
    """(time, score) by trying every window in turn."""
    best, span = 0.0, None
    for t in map(bare, texts):
        if len(t) < 6:
            continue
        for i in range(len(track)):
            for n in (1, 2, 3):
                if i + n > len(track) or track[i][0] < lo or track[i + n - 1][1] > hi:
                    continue
                w = bare(" ".join(x[2] for x in track[i : i + n]))
                if len(w) < 6:
                    continue
                own = set(t.split())
                s = 0.55 * difflib.SequenceMatcher(None, t, w).ratio() + 0.35 * len(own & set(w.split())) / len(own) + 0.1 * (t in w) - min(0.12, abs(len(w) - len(t)) / len(t) * 0.12)
                s = min(1.0, max(0.0, s))
                a, b = track[i][0], track[i + n - 1][1]
                if s > best:
                    best, span, at = s, (a, b), b if prefer_end else a
                elif span and abs(s - best) <= 0.015 and (b > span[1] if prefer_end else a < span[0]):
                    span, at = (a, b), b if prefer_end else a
    return (at, best) if span else None


def tracks():
    r = random.Random(7)
    says = lambda n: [r.choice(VOCAB) for _ in range(n)]
    lines = {k: [says(r.randrange(3, 12)) for _ in range(40)] for k in range(4)}
    asked = {}
    for q in range(24):
        k, i = r.randrange(4), r.randrange(38)
        ws = [w for line in lines[k][i : i + r.choice([1, 2, 3])] for w in line]
        for _ in range(r.choice([0, 1, 2])):
            ws[r.randrange(len(ws))] = r.choice(VOCAB)
        asked[q] = [" ".join(ws).capitalize() + "!", " ".join(ws[:10])]
    asked[98], asked[99] = ["a b"], []
    return {k: [(i * 3.0, i * 3.0 + 2.5, " ".join(x) + r.choice(["", "?", ", -"])) for i, x in enumerate(v)] for k, v in lines.items()}, asked


@pytest.mark.parametrize("prefer_end", [False, True])
def test_find_anchors(spark, prefer_end):
    lines, asked = tracks()
    entries = spark.createDataFrame([(k, i, *x) for k, v in lines.items() for i, x in enumerate(v)], "track int, place long, start_s double, end_s double, text string")
    queries = spark.createDataFrame(list(asked.items()), "q int, texts array<string>")
    find = lambda gram: {(r["q"], r["track"]): (r["at_s"], r["score"]) for r in anchors.find_anchors(queries, entries, "q", "track", "place", prefer_end, gram, 0.5).collect()}
    true = {(q, k): x for q, t in asked.items() for k, v in lines.items() if (x := spoken(t, v, prefer_end)) and x[1] >= 0.5}
    assert len(true) >= 24
    got = find(1)  # windows with a word in common are all that can score 0.5, but for chance likeness of letters
    found = sum(k in got and got[k] == (x[0], pytest.approx(x[1])) for k, x in true.items())
    assert found / len(true) >= 0.98 and set(got) <= set(true)
    got = find(3)
    strong = {k: x for k, x in true.items() if x[1] >= 0.7}  # those that an alignment would take
    assert all(got[k] == (x[0], pytest.approx(x[1])) for k, x in strong.items())


def test_bounds_of_the_search(spark):
    lines, asked = tracks()
    entries = spark.createDataFrame([(k, i, *x) for k, v in lines.items() for i, x in enumerate(v)], "track int, place long, start_s double, end_s double, text string")
    rows = [(q, t, q % 4, 20.0, 80.0) for q, t in asked.items()]
    queries = spark.createDataFrame(rows, "q int, texts array<string>, track int, lo double, hi double")
    got = {(r["q"], r["track"]): (r["at_s"], r["score"]) for r in anchors.find_anchors(queries, entries, "q", "track", "place", gram=1, least=0.45).collect()}
    true = {(q, k): x for q, t, k, lo, hi in rows if (x := spoken(t, lines[k], False, lo, hi)) and x[1] >= 0.45}
    assert got.keys() == true.keys() and all(got[k] == (x[0], pytest.approx(x[1])) for k, x in true.items())


def test_ratio(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("ab cd") for _ in range(n)), "".join(r.choice("ab cd") for _ in range(m))) for n in (0, 3, 40, 260) for m in (0, 5, 50, 300)] + [(None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(fuzzy.ratio("a", "b")).collect()
    assert [g[0] for g in got] == [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_candidates(spark):
    long = " ".join(f"w{i}" for i in range(25))
    rows = [(["Too short.", "I will not go there!", long, "last, last of all four"],), ([None, "i WILL not go there", "I will not go there?"],), (None,), ([],)]
    df = spark.createDataFrame(rows, "d array<string>")
    got = df.select(fuzzy.candidates(F.col("d")), fuzzy.candidates(F.col("d"), from_end=True)).collect()
    ten = lambda a: " ".join(f"w{i}" for i in range(a, a + 10))
    assert got[0][0] == ["I will not go there!", long, ten(0), ten(15), ten(7)]
    assert got[0][1] == ["last, last of all four", long, ten(0), ten(15), ten(7), "I will not go there!"]
    assert [tuple(g) for g in got[1:]] == [(["i WILL not go there"], ["I will not go there?"]), ([], []), ([], [])]


def test_confidence(spark):
    rows = [("full", 0.8, 0.6, True), ("partial", None, 0.9, False), ("none", 0.2, 0.4, True), ("none", None, None, True), ("none", 0.5, None, False), ("full", None, None, False), ("full", 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "q string, a double, b double, w boolean")
    assert [r[0] for r in df.select(anchors.confidence(*map(F.col, "qabw"))).collect()] == [0.745, 0.82, 0.34, 0.30, 0.235, 0.10, 0.99]


def test_only_windows_with_shared_words_are_formed(spark, monkeypatch):
    """Of a long track only the entries around those that begin with a query's words are cut into windows; windows shorter than a gram count too."""
    lines = [(0, i, i * 3.0, i * 3.0 + 3, f"filler{i} words{i} that{i} share{i} nothing{i}") for i in range(400)] + [(1, 0, 0.0, 3.0, "goodbye friend")]
    lines[200] = (0, 200, 600.0, 603.0, "the old mill stands by the river")
    formed, cut = [], anchors._cut
    monkeypatch.setattr(anchors, "_cut", lambda df, *a: formed.append(df.count()) or cut(df, *a))
    asked = spark.createDataFrame([(7, ["The old mill stands by the river!"]), (8, ["Goodbye, friend"])], "q int, texts array<string>")
    got = anchors.find_anchors(asked, spark.createDataFrame(lines, "k int, place long, start_s double, end_s double, text string"), "q", "k", "place", gram=3, least=0.5)
    assert {(r["q"], r["k"], r["at_s"], round(r["score"], 6)) for r in got.collect()} == {(7, 0, 600.0, 1.0), (8, 1, 0.0, 1.0)}
    assert formed == [4]
