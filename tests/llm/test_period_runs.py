"""Periodic runs against a search of all stretches of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from filmloom.llm import period_runs as pr
from tests.llm.test_operators import SCHEMA, texts


def brute(w, least=12):
    out, n = set(), len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - a >= p and i - a + p >= least and not any(w[a : i + p - q] == w[a + q : i + p] for q in range(1, p)):
                out.add((a, i + p - a, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_find_runs(least):
    r = random.Random(least)
    for _ in range(700):
        n, k = r.choice([0, 1, 2, 11, 12, 13, 24, 40, 90]), r.choice([1, 2, 2, 3, 5, 50])
        w = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.6:
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // 2))
            w = w[:a] + [w[a + j % p] for j in range(n - a)]
        assert [tuple(x) for x in pr.find_runs(np.array(w, np.int64), least).tolist()] == brute(w, least)


def digests(key, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and words:
        a = (h // 10) % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query(spark, tmp_path):
    phrase = " ".join(f"w{i}" for i in range(7))
    t = [*(x for x in texts() if len(x or "") < 5000), "a " * 40, f"{phrase} " * 5 + "end", f"start {phrase} {phrase}\n{phrase} a a a a a a a a a a a a a", "é " * 12]
    rows = [(i, x, None, True, i, 1, "k", 2) for i, x in enumerate(t * 3)] + [(None, "b " * 30, None, None, None, None, None, None)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, pr.op11_period_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digests(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_long_text_and_empty_table(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(5000)}" for _ in range(400_000)]
    words[1000:61000] = words[1000:1300] * 200
    docs = spark.createDataFrame([("x", " ".join(words))], "`my.id` string, text string")
    (row,) = pr.period_runs(docs, "my.id").collect()
    assert [(s.start, s.period) for s in row.runs] == [(1000, 300)] and row.runs[0].length >= 60000
    assert row.collapsed.split() == words[:1300] + words[1000 + row.runs[0].length :]
    assert pr.period_runs(docs.limit(0), "my.id").count() == 0
