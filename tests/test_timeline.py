"""Cases worked out by hand: cues, chunks, time scores and sources."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filmloom.functions import temporal
from filmloom.operators import search, timeline
from filmloom.sources.chunks import read_chunks
from filmloom.sources.subtitles import read_subtitles


def test_cue_text(spark):
    chunks = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 20.0, 30.0), (1, 3, 50.0, 60.0)], "m int, chunk int, s0 double, s1 double")
    cues = spark.createDataFrame([(1, 1, 1.0, 2.5, "a"), (1, 2, 9.5, 12.0, "b"), (1, 3, 33.0, 34.0, "c"), (1, 4, 47.0, 48.0, "d")], "m int, cue_id int, c0 double, c1 double, text string")
    got = timeline.cue_text(chunks, cues, "m", "chunk", 0.3, 1.0, 5.0, 10.0)
    assert {r["chunk"]: r["cues"] for r in got.collect()} == {1: "a", 2: "", 3: "d"}


def test_greedy_chunks(spark):
    df = spark.createDataFrame([("x", *p) for p in [(25.0, 31.0), (0.0, 12.0), (12.0, 25.0), (31.0, 40.0), (70.0, 75.0)]] + [("y", None, 1.0)], "m string, s double, e double")
    got = timeline.greedy_chunks(df, ["m"], "s", "e", 30.0).orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [("x", 0, 0.0, 25.0, 2), ("x", 1, 25.0, 40.0, 2), ("x", 2, 70.0, 75.0, 1)]


def test_temporal_scores(spark):
    df = spark.createDataFrame([(90.0, 110.0), (160.0, 190.0), (500.0, 520.0), (30.0, 40.0), (3600.0, 3610.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(temporal.at_time(a, b, 100), temporal.first_occurrence(a, F.lit("")), temporal.last_occurrence(a)).collect()
    assert [round(r[0], 6) for r in got[:3]] == [1.0, 0.8, 0.0]
    assert (got[3][1], got[4][1], round(got[4][2], 6)) == (1.0, 0.5, 0.8)


def test_nearest_within_cuts_large_groups(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 2)
    df = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(7)] + [(9, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: (r["nearest"], r["score"]) for r in search.nearest_within(df, "label").collect()}
    assert got == {0: (1, 1.0), **{i: (6, 6.0 * i + 1) for i in range(1, 6)}, 6: (5, 31.0)}  # of equal scores, the smaller id


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿1\r\n00:00:01,500 --> 00:00:03,000\r\n<i>Hello</i>\r\n  there\r\n\r\n2\r\nno time\r\n\r\n00:01:00.25 --> 01:00:00,000\r\nZoë\r\n\r\n4\r\n00:00:05,000 --> 00:00:06,000\r\n".encode())
    (tmp_path / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\nZo\xeb\n".encode("latin-1"))
    got = [(r["path"][-5:], r["start_s"], r["end_s"], r["text"]) for r in read_subtitles(spark, str(tmp_path)).orderBy("path", "start_s").collect()]
    assert got == [("a.srt", 1.5, 3.0, "Hello there"), ("a.srt", 60.025, 3600.0, "Zoë"), ("b.srt", 1.0, 2.0, "Zoë")]


def test_chunk_envelopes(spark, tmp_path):
    own = [{"chunk_id": "a", "x": 1}, {"chunk_id": "b", "extra": 2}]
    for name, what in {"1": own, "2": {"metadata": {}, "chunks": own}, "3": {"all_chunks": own[:1]}, "4": {"other": 1}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(what))
    got = read_chunks(spark, str(tmp_path), StructType.fromDDL("chunk_id string, x int")).collect()
    assert sorted((r["chunk_id"], r["x"] or 0) for r in got) == [("a", 1)] * 3 + [("b", 0)] * 2
