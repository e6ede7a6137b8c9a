"""Names, times and grades: cases worked out by hand."""

from pyspark.sql import functions as F

from filmloom.functions import names, temporal
from filmloom.operators import grading, sequences


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {'double' if isinstance(values[0], float) else 'string'}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    assert one(spark, names.stem, "running", "painters", "flies", "was", None) == ["runn", "paint", "fli", "was", ""]
    assert one(spark, names.entity_key, 'Dr. "Mal" Crowe (V.O.)', None) == ["DR MAL CROWE", ""]
    assert one(spark, names.relation_type, "is friend-of", "3rd cousin", "", None) == ["IS_FRIEND_OF", "REL_3RD_COUSIN", "RELATED_TO", "RELATED_TO"]
    assert one(spark, names.plain_field, " A-b  C!", None) == ["a b c", ""]
    assert one(spark, names.clean_text, " a \n b\x1c\tc \u2003\u3000", None) == ["a b c", ""]


def test_times(spark):
    assert one(spark, temporal.timecode, 3661.5, 60.0, -1.0, None) == ["01:01:01.50", "00:01:00", "00:00:00", "00:00:00"]
    assert one(spark, temporal.clock, 3661.0, 61.0) == ["1:01:01", "1:01"]


def test_grade(spark):
    rows = [("a", 1, 0.6), ("a", 2, 0.2), ("b", 1, 0.1), ("b", 2, 0.2), ("b", 3, 0.3), ("b", 4, 0.4), ("c", 1, None)]
    got = grading.grade(spark.createDataFrame(rows, "k string, rank int, s double"), "k", "rank", "s").collect()
    assert sorted((r["k"], r["rank"], round(r["avg_score"], 6), r["needs_rewrite"]) for r in got) == [("a", 1, 0.4, True), ("b", 1, 0.25, False), ("b", 2, 0.25, False), ("b", 3, 0.25, False), ("c", 1, 0.0, True)]


def test_sequences(spark):
    rows = [("x", i) for i in range(10)] + [("y", i) for i in range(3)]
    got = sequences.thin(spark.createDataFrame(rows, "k string, p int"), "k", "p", 4).collect()
    assert sorted(tuple(r) for r in got) == [("x", 0), ("x", 2), ("x", 5), ("x", 7), ("y", 0), ("y", 1), ("y", 2)]
    df = spark.createDataFrame([([10.0, 40.0, 55.0, 90.0], 120.0), ([30.0, 30.0, 60.0], 60.0), ([], 9.0), (None, 9.0)], "b array<double>, d double")
    assert [r[0] for r in df.select(sequences.min_duration(F.col("b"), F.col("d"), 30.0)).collect()] == [[40.0, 90.0], [30.0], [], []]
    df = spark.createDataFrame([("The RED door!", ["red-door", "x"]), ("the red", ["blue", ""]), ("", ["a"]), ("a", None)], "t string, e array<string>")
    assert [r[0] for r in df.select(sequences.matches_any(F.col("t"), F.col("e"))).collect()] == [True, False, False, False]
