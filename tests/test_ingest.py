"""Commits that are seen whole, keys that are replaced whole, and runs that die on the way."""

import pytest
from pyspark.sql import functions as F

from filmloom.operators.ingest import Ingest

from filmloom.sinks.keyed import Conflict, KeyedTable, write_chunk_files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_leaves_no_stale_row(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "movie")
    assert t.read() is None and t.version() == 0
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 9)], "movie string, n int")
    assert t.upsert(first) == 1 and rows(t.read()) == rows(first)
    t.upsert(spark.createDataFrame([("a", 7, "x"), ("c", 8, "y"), (None, 10, "z")], "movie string, n int, text string"))
    want = sorted([("a", 7, "x"), ("b", 3, None), ("c", 8, "y"), (None, 10, "z")], key=str)
    assert rows(t.read()) == want
    t.upsert(spark.createDataFrame([("a", 7)], "movie string, n int"), gone=spark.createDataFrame([("c",)], "key string"))
    want = sorted([("a", 7, None), ("b", 3, None), (None, 10, "z")], key=str)
    assert rows(t.read()) == want and rows(t.read(1)) == rows(first)  # a reader of an older version still sees it whole
    assert t.compact() == 4 and rows(t.read()) == want


def test_interrupted_and_overtaken_writes(spark, tmp_path, monkeypatch):
    t, other = KeyedTable(spark, str(tmp_path), "k"), KeyedTable(spark, str(tmp_path), "k")
    t.upsert(spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"))
    with monkeypatch.context() as m:
        m.setattr(t, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.upsert(spark.createDataFrame([(1, "lost")], "k int, v string"))
    assert rows(t.read()) == [(1, "old"), (2, "old")]
    real, raced = t._commit, []

    def late(*a):
        if not raced:
            raced.append(other.upsert(spark.createDataFrame([(2, "other")], "k int, v string")))
        return real(*a)

    monkeypatch.setattr(t, "_commit", late)
    assert t.upsert(spark.createDataFrame([(1, "new")], "k int, v string")) == 3
    assert rows(other.read()) == [(1, "new"), (2, "other")]
    with pytest.raises(Conflict):
        real(3, {})


def test_chunk_files(spark, tmp_path):
    folder = f"{tmp_path}/chunks"
    write_chunk_files(spark.createDataFrame([("a", 1), ("b", 2)], "movie string, n int"), folder, "movie")
    write_chunk_files(spark.createDataFrame([("b", 3), ("b", 4)], "movie string, n int"), folder, "movie")
    assert rows(spark.read.json(folder).select("movie", "n")) == [("a", 1), ("b", 3), ("b", 4)]


def step(items):
    """Two chunks an item, none for those that end in 7."""
    return items.where("item NOT LIKE '%7'").select("item", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"), F.concat("item", F.lit("!")).alias("text"))


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame([(f"m{i}",) for i in range(20)] + [("m3",), (None,)], "item string")
    clean = Ingest(KeyedTable(spark, f"{tmp_path}/m0", "item"), KeyedTable(spark, f"{tmp_path}/t0", "item"), step, batches=3)
    clean.add(items)
    assert clean.run() == {"completed": 18, "incomplete": 2}

    class Killed(BaseException):
        pass

    ran = Ingest(KeyedTable(spark, f"{tmp_path}/m1", "item"), KeyedTable(spark, f"{tmp_path}/t1", "item"), step, batches=3)
    ran.add(items)
    calls, real = [], ran.target.upsert

    def dies_after_writing(*a, **k):
        out = real(*a, **k)
        calls.append(out)
        if len(calls) == 2:
            raise Killed
        return out

    monkeypatch.setattr(ran.target, "upsert", dies_after_writing)
    with pytest.raises(Killed):
        ran.run()
    assert 0 < ran.summary()["running"] < 20 and ran.summary()["pending"] > 0
    again = Ingest(KeyedTable(spark, f"{tmp_path}/m1", "item"), KeyedTable(spark, f"{tmp_path}/t1", "item"), step, batches=3)
    again.add(items)
    assert again.run() == {"completed": 18, "incomplete": 2} and rows(again.target.read()) == rows(clean.target.read())


def test_failed_steps_are_taken_again(spark, tmp_path):
    broken = [True]

    def sometimes(items):
        if broken[0]:
            raise ValueError("no disk")
        return step(items)

    run = Ingest(KeyedTable(spark, f"{tmp_path}/m", "item"), KeyedTable(spark, f"{tmp_path}/t", "item"), sometimes, batches=1, attempts=2)
    run.add(spark.createDataFrame([("a",), ("b7",)], "item string"))
    assert run.run() == {"failed": 2}
    assert rows(run.manifest.read().select("item", "attempt_count", "last_error")) == [("a", 1, "ValueError: no disk"), ("b7", 1, "ValueError: no disk")]
    broken[0] = False
    assert run.run() == {"completed": 1, "incomplete": 1} and run.run() == {"completed": 1, "incomplete": 1}
    assert rows(run.manifest.read().select("item", "attempt_count")) == [("a", 2), ("b7", 2)]


