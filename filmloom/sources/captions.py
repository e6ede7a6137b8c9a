"""Caption data sets and scene annotations as chunks, moments and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How long a captioned video is taken to be, frames a second where none are told.
CLIP_SECONDS, FPS = 10.0, 24.0


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, name (without ending) and data of JSON files, each one value; files that are none have null data."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("name"), "value")
    return text.select("path", "name", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("data"))


def _chunks(rows: DataFrame, movie: str, kind: str) -> DataFrame:
    """The columns that all caption chunks have."""
    return rows.select("chunk_id", "video_id", F.lit(movie).alias("movie_id"), "start_seconds", "end_seconds", (F.col("end_seconds") - F.col("start_seconds")).alias("duration"), F.col("said").alias("description"), F.col("said").alias("text"), F.lit("en").alias("language"), F.lit(kind).alias("type"), F.lit(movie).alias("source"), "split")


def read_caption_list(spark: SparkSession, path: str, movie: str, prefix: str) -> DataFrame:
    """Chunks of files that list items {video_id, caption, split}: one an item with a caption, from 0 to CLIP_SECONDS.

    An item without a video is named by its place, one without a split is for training.
    """
    items = _files(spark, path, "array<struct<video_id: string, caption: string, split: string>>").select(F.posexplode("data").alias("nth", "i")).where("i.caption <> ''")
    video = F.coalesce("i.video_id", F.concat(F.lit("video"), F.col("nth").cast("string")))
    rows = items.select(F.concat_ws("_", F.lit(prefix), video, F.lpad(F.col("nth").cast("string"), 5, "0")).alias("chunk_id"), video.alias("video_id"), F.lit(0.0).alias("start_seconds"), F.lit(CLIP_SECONDS).alias("end_seconds"), F.col("i.caption").alias("said"), F.coalesce("i.split", F.lit("train")).alias("split"))
    return _chunks(rows, movie, "caption")


def read_caption_map(spark: SparkSession, path: str, movie: str, prefix: str) -> DataFrame:
    """Chunks of files that map videos to {sentences, timestamps}: one a sentence that has both ends of its time."""
    videos = _files(spark, path, "map<string, struct<sentences: array<string>, timestamps: array<array<double>>>>").select(F.explode("data").alias("video_id", "v"))
    n = F.least(F.size("v.sentences"), F.size("v.timestamps"))
    each = videos.select("video_id", F.posexplode(F.slice(F.arrays_zip(F.col("v.sentences").alias("s"), F.col("v.timestamps").alias("t")), 1, F.greatest(n, F.lit(0)))).alias("nth", "x"))
    each = each.where((F.col("x.s") != "") & (F.size("x.t") >= 2))
    rows = each.select(F.concat_ws("_", F.lit(prefix), "video_id", F.lpad(F.col("nth").cast("string"), 4, "0")).alias("chunk_id"), "video_id", F.col("x.t")[0].alias("start_seconds"), F.col("x.t")[1].alias("end_seconds"), F.col("x.s").alias("said"), F.lit(None).cast("string").alias("split"))
    return _chunks(rows, movie, "caption")


def read_moments(spark: SparkSession, path: str, movie: str, prefix: str) -> DataFrame:
    """Chunks of files <split>_data.json that list {dl_link, description, times}: one a time with both ends; the video is the number after id= in the link."""
    items = _files(spark, path, "array<struct<dl_link: string, description: string, times: array<array<double>>>>").select(F.regexp_extract("name", r"^(.*?)(_data)?$", 1).alias("split"), F.explode("data").alias("i"))
    video = F.regexp_extract(F.coalesce("i.dl_link", F.lit("")), r"id=(\d+)", 1)
    each = items.select("split", video.alias("video_id"), F.coalesce("i.description", F.lit("")).alias("said"), F.posexplode("i.times").alias("nth", "t")).where(F.size("t") >= 2)
    rows = each.select(F.concat_ws("_", F.lit(prefix), "video_id", F.lpad(F.col("nth").cast("string"), 4, "0")).alias("chunk_id"), "video_id", F.col("t")[0].alias("start_seconds"), F.col("t")[1].alias("end_seconds"), "said", "split")
    return _chunks(rows, movie, "moment_description")


def read_segments(spark: SparkSession, path: str, movie: str, prefix: str) -> DataFrame:
    """Chunks of files {database: {video: {subset, duration, annotations: [{segment, label}]}}}: one an annotation with both ends; ids hold hundredths of a second."""
    schema = "struct<database: map<string, struct<subset: string, duration: double, annotations: array<struct<segment: array<double>, label: string>>>>>"
    videos = _files(spark, path, schema).select(F.explode("data.database").alias("video_id", "v"))
    each = videos.select("video_id", "v.subset", F.explode("v.annotations").alias("a")).where(F.size("a.segment") >= 2)
    start = F.col("a.segment")[0]
    rows = each.select(F.concat_ws("_", F.lit(prefix), "video_id", F.lpad(F.floor(start * 100).cast("string"), 8, "0")).alias("chunk_id"), "video_id", start.alias("start_seconds"), F.col("a.segment")[1].alias("end_seconds"), F.col("a.label").alias("said"), F.col("subset").alias("split"))
    return _chunks(rows, movie, "activity_video")


def ground_truth(chunks: DataFrame) -> DataFrame:
    """video_id, n_moments, moments (by start, end, text) of chunks with a video and a text."""
    own = chunks.where("video_id <> '' AND description <> ''")
    moment = F.struct("start_seconds", "end_seconds", "description")
    return own.groupBy("video_id").agg(F.count("*").alias("n_moments"), F.array_sort(F.collect_list(moment)).alias("moments"))


def read_annotation_scenes(spark: SparkSession, path: str, fps: Column | None = None) -> DataFrame:
    """movie_id (the file's name), scene_idx, shot_start, shot_end, start_seconds, end_seconds, duration_seconds, place_tag, action_tag of files {fps, scene: [{frame, shot, place_tag, action_tag}]}.

    Scenes without two frames and two shots are left out, but keep their number. fps: overrides the file's, FPS if neither is known.
    """
    schema = "struct<fps: double, scene: array<struct<frame: array<double>, shot: array<int>, place_tag: string, action_tag: string>>>"
    each = _files(spark, path, schema).select(F.col("name").alias("movie_id"), F.coalesce(*([fps] if fps is not None else []), F.col("data.fps"), F.lit(FPS)).alias("fps"), F.posexplode("data.scene").alias("scene_idx", "s"))
    frame = F.coalesce("s.frame", F.array(F.lit(0.0), F.lit(0.0)))
    shot = F.coalesce("s.shot", F.array(F.lit(0), F.lit(0)))
    whole = each.where((F.size(frame) >= 2) & (F.size(shot) >= 2))
    start, end = frame[0] / F.col("fps"), frame[1] / F.col("fps")
    return whole.select("movie_id", "scene_idx", shot[0].alias("shot_start"), shot[1].alias("shot_end"), F.round(start, 2).alias("start_seconds"), F.round(end, 2).alias("end_seconds"), F.round(end - start, 2).alias("duration_seconds"), "s.place_tag", "s.action_tag")
