"""Tracks on a stream against a loop over frames, in one batch, in many out of order, and after a failure."""

import random

import pytest
from pyspark.sql import functions as F

from filmloom.scratch import new_path
from filmloom.streaming import tracker

SHAPE = "video string, frame long, det long, at timestamp, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0, w) * max(0, h)
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / both if both > 0 else 0.0


def tracks(frames, least, most_missed):
    """(frame, det) -> track; frames: those of one video with their boxes, in order."""
    out, live, following = {}, {}, 0
    for frame, dets in frames:
        used = set()
        for det, box in dets:
            best, score = None, least
            for t, (last, _) in live.items():
                if t not in used and overlap(box, last) >= score:
                    best, score = t, overlap(box, last)
            if best is None:
                best, following = following, following + 1
            live[best] = (box, 0)
            used.add(best)
            out[frame, det] = best
        live = {t: (b, m if t in used else m + 1) for t, (b, m) in live.items()}
        live = {t: x for t, x in live.items() if x[1] <= most_missed}
    return out


def detections():
    r = random.Random(3)
    rows = []
    for video in "abc":
        at = [[r.uniform(0, 50), r.uniform(0, 50)] for _ in range(4)]
        for frame in range(60):
            if r.random() < 0.15:
                continue
            for det in range(r.randrange(1, 5)):
                x, y = at[det][0] + r.uniform(-3, 3) + frame / 4, at[det][1] + r.uniform(-3, 3)
                rows.append((video, frame, det, frame, x, y, x + 10, y + 10))
    return rows


def expected(rows, closed, least=0.3, most_missed=2):
    out = {}
    for video in {r[0] for r in rows}:
        frames: dict = {}
        for _, frame, det, _, *box in sorted(r for r in rows if r[0] == video and r[1] <= closed):
            frames.setdefault(frame, []).append((det, box))
        out |= {(video, *k): t for k, t in tracks(sorted(frames.items()), least, most_missed).items()}
    return out


def files(spark, rows, folder, parts):
    """The rows as files, in order of time but for neighbouring frames, which the delay allows to be mixed."""
    r = random.Random(1)
    rows = sorted(rows, key=lambda x: (x[1] + r.uniform(0, 3.5), x[0]))
    for k in range(parts):
        part = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        spark.createDataFrame([(v, f, d, None, *b) for v, f, d, _, *b in part], SHAPE).withColumn("at", F.timestamp_seconds(F.col("frame") + 1000)).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return tracker.track(spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(folder), most_missed=2, delay="5 seconds")


def rows_of(df):
    got = df.collect()
    assert len({(r[0], r[1], r[2]) for r in got}) == len(got)
    return {(r["video"], r["frame"], r["det"]): r["track"] for r in got}


@pytest.mark.parametrize("parts", [1, 6])
def test_stream_equals_a_loop(spark, tmp_path, parts):
    rows = detections()
    last = max(r[1] for r in rows)
    files(spark, rows, f"{tmp_path}/in", parts)
    assert rows_of(tracker.stream_to_table(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out")) == expected(rows, last - 5 - 1)


def test_restart_goes_on(spark, tmp_path):
    """The first run sees half of the files; the second, from the same checkpoint, the rest."""
    rows = detections()
    half = [r for r in rows if r[1] < 30]
    files(spark, half, f"{tmp_path}/in", 3)
    first = rows_of(tracker.stream_to_table(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out"))
    assert first == expected(half, max(r[1] for r in half) - 6)
    files(spark, [r for r in rows if r[1] >= 30], f"{tmp_path}/in", 3)
    assert rows_of(tracker.stream_to_table(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out")) == expected(rows, max(r[1] for r in rows) - 6)


def test_idle_videos_lose_their_state(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for rows in ([("a", 0), ("b", 0)], [("b", 100)], [("a", 101), ("b", 101)], [("b", 120)]):
        spark.createDataFrame([(v, f, 0, None, 0.0, 0.0, 9.0, 9.0) for v, f in rows], SHAPE).withColumn("at", F.timestamp_seconds(F.col("frame") + 1000)).coalesce(1).write.mode("append").parquet(folder)
        out = tracker.track(spark.readStream.schema(SHAPE).parquet(folder), most_missed=500, idle_ms=50_000)
        got = rows_of(tracker.stream_to_table(out, f"{tmp_path}/out"))
    assert got["b", 101, 0] == 0 and got["a", 101, 0] == 0  # a's number starts anew
    assert set(got) == {("a", 0, 0), ("b", 0, 0), ("b", 100, 0), ("a", 101, 0), ("b", 101, 0)}


def test_events(spark, tmp_path):
    """The registered query over half a table's events, against the loop."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = [(r["video"], r["frame"], r["det"], 0, r["x1"], r["y1"], r["x2"], r["y2"]) for r in tracker.event_boxes(events).collect()]
    got = rows_of(tracker.tracked_events(spark, "/root/testdata/sf0.001/events.parquet", new_path(spark, "t")))
    assert got == expected(rows, max(r[1] for r in rows) - 1, most_missed=3)


def test_small_frames_need_no_arrays(monkeypatch):
    """Frames of a few boxes are compared box by box, with the very numbers that arrays give."""
    r = random.Random(5)
    boxes = [[x := r.uniform(0, 9), y := r.uniform(0, 9), x + r.uniform(0, 5), y + r.uniform(0, 5)] for _ in range(40)]
    assert [[tracker._iou(p, q) for q in boxes] for p in boxes] == tracker.iou(tracker.np.array(boxes), tracker.np.array(boxes)).tolist()
    frames = [boxes[i : i + r.randrange(1, 5)] for i in range(30)]
    arrays = tracker.Tracks()
    monkeypatch.setattr(tracker, "FEW", -1)
    want = [arrays.step(f, 0.2, 2) for f in frames]
    monkeypatch.setattr(tracker, "FEW", 64)
    monkeypatch.setattr(tracker, "iou", None)
    single = tracker.Tracks()
    assert [single.step(f, 0.2, 2) for f in frames] == want
