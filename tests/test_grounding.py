"""Questions about time, excerpts and merged hits: cases worked out by hand."""

from pyspark.sql import functions as F

from filmloom.functions import excerpts, questions
from filmloom.operators import hits


def test_expressions(spark):
    asked = ["at 1:30", "at 2 hrs", "first rain", "the first time Neo appears", "after the storm", "", None]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, q string").orderBy("i")
    got = [r[0] and tuple(r[0]) for r in df.select(questions.expression(F.col("q"))).collect()]
    assert got == [("at_time", 90.0, None, 1.0), ("at_time", 7200.0, None, 0.9), ("first_occurrence", None, "rain", 0.8), ("first_occurrence", None, "Neo", 0.9), ("after_event", None, "the", 0.85), None, None]


def test_scores(spark):
    rows = [("at 5:00", 600.0, 660.0, None, None), ("before Storm happens", 0.0, 50.0, None, 60.0), ("after Storm", 0.0, 50.0, None, 150.0), ("during Storm", 0.0, 9.0, None, None), ("when does Neo appear", 0.0, 9.0, ["Old Neo"], None), ("when does Neo appear", 0.0, 9.0, None, None), ("x", None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, s double, e double, names array<string>, at double").orderBy("i")
    got = df.select(questions.score(questions.expression(F.col("q")), F.col("s"), F.col("e"), F.lit(None).cast("string"), F.col("names"), F.col("at"))).collect()
    assert [round(r[0], 6) for r in got] == [0.0, 1.0, 0.5, 0.6, 0.95, 0.5, 2.0]


def test_excerpts(spark):
    df = spark.createDataFrame([(1, "Hello  there. Dr. Who came! Why?\nYes"), (2, None), (3, "abcdefghijkl")], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(excerpts.sentences(F.col("t"))).collect()] == [["Hello there.", "Dr. Who came!", "Why?", "Yes"], [], ["abcdefghijkl"]]
    assert [r[0] for r in df.select(excerpts.truncate_text(F.col("t"), 13)).collect()] == ["Hello there...", "", "abcdefghijkl"]


def test_hits(spark):
    rows = [("a", 0.5, "x", 1), ("a", 0.5, "y", 2), ("b", 0.1, "x", 1), ("b", 0.9, "y", 2), ("c", None, None, 1), (None, 1.0, "x", 1)]
    got = hits.best_hits(spark.createDataFrame(rows, "n string, s double, src string, p int"), "n", "s", "src", "p").collect()
    assert sorted(map(str, map(tuple, got))) == ["('a', 0.5, 1, 'hybrid')", "('b', 0.9, 2, 'y')", "('c', 0.0, 1, None)"]


def test_upsert_and_quota(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert sorted(map(str, map(tuple, hits.upsert(old, spark.createDataFrame([("a", 9), (None, 8)], "k string, v int"), "k").collect()))) == ["('a', 9)", "('b', 2)", "(None, 8)"]
    assert hits.upsert(old, old.limit(0), "k").count() == 3
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("a", 3, 3.0), ("b", 4, 1.0)], "k string, i int, s double")
    assert sorted(r["i"] for r in hits.quota_with_leftovers(rows, "k", 2, "s", "i", 3).collect()) == [1, 2, 4]
    assert sorted(r["i"] for r in hits.quota_with_leftovers(rows, "k", 2, "s", "i", 1).collect()) == [1]
    assert hits.quota_with_leftovers(rows.limit(0), "k", 2, "s", "i", 3).count() == 0
