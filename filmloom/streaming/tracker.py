"""Boxes of successive frames joined into tracks, on a stream, with tracks and videos that expire."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from filmloom.scratch import new_path

#: A video's state: the next track's number; numbers, boxes (four at a time) and frames missed of its tracks; detections of frames that are not complete.
STATE = "next long, ids array<long>, boxes array<double>, missed array<int>, w_frame array<long>, w_det array<long>, w_ms array<long>, w_boxes array<double>, last_ms long"
BOX = ["x1", "y1", "x2", "y2"]
#: Pairs of boxes that are compared one by one; more go through arrays.
FEW = 64


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each box in a with each in b: the area they share over the area they cover."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.clip(high - low, 0, None).prod(2)
    area = lambda x: (x[:, 2:] - x[:, :2]).prod(1)
    both = area(a)[:, None] + area(b)[None] - shared
    return np.divide(shared, both, out=np.zeros_like(shared), where=both > 0)


def _iou(p: list[float], q: list[float]) -> float:
    """iou() of two boxes."""
    shared = max(min(p[2], q[2]) - max(p[0], q[0]), 0.0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0.0)
    both = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - shared
    return shared / both if both > 0 else 0.0


class Tracks:
    """The open tracks of a video."""

    def __init__(self, following: int = 0, ids=(), boxes=(), missed=()):
        self.following, self.ids, self.missed = following, list(ids), list(missed)
        self.boxes = np.array(boxes, float).reshape(-1, 4).tolist()

    def step(self, boxes: list[list[float]], least: float, most_missed: int) -> list[int]:
        """The track of each of a frame's boxes, in their order.

        A box goes on with the open track that it overlaps most, by `least` at least, the youngest of equal ones, unless an
        earlier box of the frame has it; else it opens a track. A track that misses more than `most_missed` frames ends.
        """
        old = len(self.ids)
        if len(boxes) * old <= FEW:  # most frames have a box or two
            over = [[_iou(p, q) for q in self.boxes] for p in boxes]
        else:
            over = iou(np.array(boxes, float), np.array(self.boxes, float).reshape(-1, 4)).tolist()
        used, out = [False] * old, []
        for box, scores in zip(boxes, over):
            best, score = -1, -1.0
            for k, x in enumerate(scores):
                if not used[k] and x >= score:
                    best, score = k, x
            if best >= 0 and score >= least:
                used[best] = True
                self.boxes[best] = box
                self.missed[best] = 0
                out.append(self.ids[best])
            else:
                out.append(self.following)
                self.ids.append(self.following)
                self.missed.append(0)
                self.boxes.append(box)
                self.following += 1
        self.missed = [m + (k < old and not used[k]) for k, m in enumerate(self.missed)]
        if self.missed and max(self.missed) > most_missed:
            stay = [k for k, m in enumerate(self.missed) if m <= most_missed]
            self.ids, self.missed, self.boxes = [self.ids[k] for k in stay], [self.missed[k] for k in stay], [self.boxes[k] for k in stay]
        return out


def track(detections: DataFrame, video: str = "video", least: float = 0.3, most_missed: int = 30, frame_ms: int = 1000, delay: str = "0 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """video, frame, det, track of a stream's detections: columns video, frame, det (their order in a frame), at (event time), x1, y1, x2, y2.

    A frame is complete when the watermark passes the end of its time: `at` plus frame_ms. Complete frames are worked off in
    order of their number, whatever batches brought them; only frames with detections count as missed by a track. Detections
    later than the watermark are dropped, as by every operator with one. A video without news for idle_ms of event time
    loses its state; if it comes back, its tracks start anew.
    """
    names = STATE.replace(",", "").split()[::2]
    kind = detections.schema[video].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, state.get)) if state.exists else dict(next=0, ids=[], boxes=[], missed=[], w_frame=[], w_det=[], w_ms=[], w_boxes=[], last_ms=0)
        passed = state.getCurrentWatermarkMs()
        frame, det, ms, boxes = s["w_frame"], s["w_det"], s["w_ms"], np.array(s["w_boxes"], float).reshape(-1, 4)
        if not state.hasTimedOut:
            new = list(frames)
            frame, det, ms = (np.concatenate([np.array(x, np.int64), *(f[c].to_numpy(np.int64) for f in new)]) for x, c in ((frame, "frame"), (det, "det"), (ms, "ms")))
            boxes = np.concatenate([boxes, *(np.stack([f[c].to_numpy(float) for c in BOX], 1) for f in new)])
        frame, det, ms = (np.array(x, np.int64) for x in (frame, det, ms))
        order = np.lexsort([det, frame])
        frame, det, ms, boxes = frame[order], det[order], ms[order], boxes[order]
        done = np.isin(frame, frame[ms + frame_ms <= passed])
        tracks = Tracks(s["next"], s["ids"], s["boxes"], s["missed"])
        if done.any():  # one table for all frames of the video: tables a frame would cost more than the tracks
            own, starts = boxes[done].tolist(), np.flatnonzero(np.diff(frame[done], prepend=frame[done][0] - 1))
            found = [t for a, b in zip(starts, [*starts[1:], len(own)]) for t in tracks.step(own[a:b], least, most_missed)]
            yield pd.DataFrame({"video": key[0], "frame": frame[done], "det": det[done], "track": found})
        left, last = ms[~done], max([s["last_ms"], *ms.tolist()])
        if not len(left) and last + idle_ms <= passed:
            state.remove()
            return
        state.update((tracks.following, tracks.ids, [float(x) for box in tracks.boxes for x in box], tracks.missed, *(x[~done].tolist() for x in (frame, det, ms)), boxes[~done].ravel().tolist(), int(last)))
        state.setTimeoutTimestamp(max(passed + 1, int(left.min()) + frame_ms if len(left) else int(last) + idle_ms))

    rows = detections.withWatermark("at", delay).withColumn("ms", F.unix_millis("at")).select(F.col(video).alias("video"), F.col("frame").cast("long"), F.col("det").cast("long"), "ms", "at", *[F.col(c).cast("double") for c in BOX])
    out = rows.groupBy("video").applyInPandasWithState(run, f"video {kind}, frame long, det long, track long", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("video", video)


def stream_to_table(out: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all its input there is now, as the table `folder`/rows; a call after a failure goes on where `folder`/checkpoint ends."""
    spark = out.sparkSession
    query = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def event_boxes(events: DataFrame) -> DataFrame:
    """Events as detections: a user is a video, an hour a frame, the value and the kind place a box."""
    frame = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 3_600_000
    place = F.pmod(F.col("value"), F.lit(60.0))
    y = F.pmod(F.xxhash64("event_type"), F.lit(3)).cast("double") * 10
    return events.select(F.col("user_id").alias("video"), F.floor(frame).alias("frame"), F.col("event_id").alias("det"), F.timestamp_millis(F.floor(frame) * 3_600_000).alias("at"), place.alias("x1"), y.alias("y1"), (place + 40).alias("x2"), (y + 40).alias("y2"))


def tracked_events(spark: SparkSession, source: str, folder: str | None = None, files: int = 1) -> DataFrame:
    """Tracks of event_boxes over the Parquet file, or the files of the folder, at source as a stream, `files` a batch."""
    either = f"{source[:-1]}[{source[-1]}]"  # a stream reads a single file by a pattern only
    events = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(either)
    return stream_to_table(track(event_boxes(events), frame_ms=3_600_000, most_missed=3, idle_ms=30 * 86_400_000), folder or new_path(spark, "tracks"))
