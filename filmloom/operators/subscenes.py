"""Script scenes within semantic scenes: overlaps, parents, and which of a script scene's parts is indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmloom.operators.timeline import interval_join, overlap
from filmloom.scratch import written

# How well a scene is anchored, and the overlap that makes any part worth an index.
QUALITY = ("linear", "partial", "full")
LEAST_OVERLAP = 5.0


def overlapping_or_nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, width: float = 120.0) -> DataFrame:
    """Pairs of rows of a key whose spans (s0, s1) and (c0, c1) share more than an end; a left row without one is paired with the right row whose start is nearest, the first in `nth` of equal ones.

    left: key, left_id, s0, s1 and more. right: key, nth, c0, c1 and more. A nearest row is sought from both sides by windows over
    starts, so that no key's pairs are formed. Both sides grow with the table, so no join broadcasts one; what is read twice is written.
    """
    spans = written(interval_join(left, right.hint("merge"), key, ("s0", "c0"), ("s1", "c1"), width).where((F.col("c1") > F.col("s0")) & (F.col("c0") < F.col("s1"))), "spans")
    alone = written(left.join(spans.select(F.col(key).alias("_k"), F.col(left_id).alias("_id")).distinct().hint("merge"), (F.col("_k") == left[key]) & (F.col("_id") == left[left_id]), "left_anti"), "alone")
    starts = right.groupBy(key, "c0").agg(F.min("nth").alias("nth"))
    both = alone.select(key, left_id, F.col("s0").alias("_t"), F.lit(None).cast("long").alias("_n"), F.lit(None).cast("double").alias("_c")).unionByName(starts.select(key, F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.col("c0").alias("_t"), F.col("nth").cast("long").alias("_n"), F.col("c0").alias("_c")))
    hit = F.when(F.col("_n").isNotNull(), F.struct(F.col("_c").alias("c"), F.col("_n").alias("n")))
    back = Window.partitionBy(key).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("_t").rangeBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_b", F.last(hit, ignorenulls=True).over(back)).withColumn("_a", F.first(hit, ignorenulls=True).over(ahead)).where("_n IS NULL")
    db, da = F.col("_t") - F.col("_b.c"), F.col("_a.c") - F.col("_t")
    pick = F.when(F.col("_b").isNull() | (da < db) | ((da == db) & (F.col("_a.n") < F.col("_b.n"))), F.col("_a")).otherwise(F.col("_b"))
    near = both.withColumn("_p", pick).where("_p IS NOT NULL").select(F.col(key).alias("_k"), F.col(left_id).alias("_id"), F.col("_p.n").alias("_nth"))
    pairs = alone.join(near.hint("merge"), (alone[key] == near["_k"]) & (alone[left_id] == near["_id"])).drop("_k", "_id")
    others = right.withColumnRenamed(key, "_k")
    filled = pairs.join(others.hint("merge"), (pairs[key] == others["_k"]) & (pairs["_nth"] == others["nth"])).drop("_k", "_nth")
    return spans.select(filled.columns).unionByName(filled)


def best_chunk(parts: DataFrame, chunks: DataFrame, key: str, part_id: str) -> DataFrame:
    """key, part_id, parent_chunk_id: of the chunks of a part's clip, and among them those of its script scene if there are any, the one that overlaps it most, then starts, then ends nearest, then comes first.

    parts: key, part_id, clip_id, uid, o0, o1. chunks: key, chunk_id, nth, clip_id, uid, k0, k1. Missing clips and scenes are empty texts.
    """
    own = chunks.select(F.col(key).alias("_k"), F.col("clip_id").alias("_clip"), F.col("uid").alias("_uid"), "chunk_id", "nth", "k0", "k1")
    both = parts.join(own.hint("merge"), (parts[key] == F.col("_k")) & (parts["clip_id"] == F.col("_clip")))
    shared = overlap(F.col("k0"), F.col("k1"), F.col("o0"), F.col("o1"))
    order = F.struct((F.col("_uid") != F.col("uid")), -shared, F.abs(F.col("k0") - F.col("o0")), F.abs(F.col("k1") - F.col("o1")), "nth")
    return both.groupBy(key, part_id).agg(F.min_by("chunk_id", order).alias("parent_chunk_id"))


def subscenes(scenes: DataFrame, scripts: DataFrame, clips: DataFrame, chunks: DataFrame, key: str = "movie_id", width: float = 120.0) -> DataFrame:
    """A row for each semantic scene and each script scene that overlaps it, or else lies nearest, with parents, ratios and what is to be indexed.

    scenes: key, scene_id, s0, s1, description. scripts: key, uid, nth, c0, c1, heading, anchor_quality, confidence. clips: key,
    scene_id, clip_id, nth, description; a scene's last clip counts. chunks: see best_chunk. A part is eligible if it
    overlaps by LEAST_OVERLAP seconds, or its scene is anchored well. Of each script scene's parts, eligible ones first, that
    with the longest overlap, best anchor, confidence, share of the script and earliest start is canonical, the first scene's of equal ones.
    width: seconds that scenes and script scenes usually last, for their join.
    """
    last = clips.groupBy(key, "scene_id").agg(F.max_by("clip_id", "nth").alias("clip_id"), F.max_by("description", "nth").alias("_told"))
    rows = overlapping_or_nearest(scenes, scripts, key, "scene_id", width).join(last.hint("merge"), [key, "scene_id"], "left").withColumn("clip_id", F.coalesce("clip_id", F.lit("")))
    o0, o1 = F.greatest("s0", "c0"), F.least("s1", "c1")
    seconds = F.greatest(F.lit(0.0), o1 - o0)
    rows = written(rows.withColumns({"o0": o0, "o1": o1, "_part": F.struct("scene_id", "nth"), "_seconds": seconds, "index_eligible": (seconds >= LEAST_OVERLAP) | F.col("anchor_quality").isin("full", "partial")}), "parts")
    parent = best_chunk(rows.select(key, "_part", "clip_id", "uid", "o0", "o1"), chunks, key, "_part")
    rows = rows.join(parent.hint("merge"), [key, "_part"], "left")
    ratio = lambda a, b: F.round(F.col("_seconds") / F.greatest(F.col(b) - F.col(a), F.lit(1.0)), 3)
    rows = written(rows.withColumns({"overlap_seconds": F.round("_seconds", 2), "overlap_ratio_semantic": ratio("s0", "s1"), "overlap_ratio_script": ratio("c0", "c1"), "start_seconds": F.round("o0", 2), "end_seconds": F.round("o1", 2), "confidence_score": F.round(F.coalesce("confidence", F.lit(0.0)), 3)}), "parents", rows)
    place = F.coalesce(F.array_position(F.array(*[F.lit(q) for q in QUALITY]), F.col("anchor_quality")), F.lit(0))
    best = F.min(F.struct(~F.col("index_eligible"), -F.col("overlap_seconds"), -F.greatest(place, F.lit(1)), -F.col("confidence_score"), -F.col("overlap_ratio_script"), "start_seconds", "scene_id"))
    chosen = rows.groupBy(F.col(key).alias("_k"), F.col("uid").alias("_u")).agg(best.alias("_best"), F.count("*").alias("split_count"))
    out = rows.join(chosen.hint("merge"), (rows[key] == F.col("_k")) & (rows["uid"] == F.col("_u"))).withColumn("is_canonical", F.col("scene_id") == F.col("_best.scene_id"))
    return out.select(
        key, "scene_id", "uid", F.coalesce("parent_chunk_id", F.lit("")).alias("parent_chunk_id"), F.col("clip_id").alias("parent_clip_id"), "start_seconds", "end_seconds", "heading", "anchor_quality", "confidence_score", "overlap_seconds", "overlap_ratio_semantic", "overlap_ratio_script",
        F.coalesce("_told", "description").alias("semantic_description"), "split_count", "index_eligible", "is_canonical", (F.col("is_canonical") & F.col("index_eligible")).alias("indexable"),
    )


def match_clips(clips: DataFrame, scenes: DataFrame, key: str, clip_id: str, width: float = 64.0) -> DataFrame:
    """key, clip_id, scene_idx: the scene of each clip, by shots: the one it overlaps most, else the first that holds its start, else the one numbered as its start; null if there is none.

    clips: key, clip_id, c0, c1. scenes: key, scene_idx (their order), s0, s1. Of equal overlaps the first scene counts; sharing an end is no overlap.
    """
    both = interval_join(clips, scenes, key, ("c0", "s0"), ("c1", "s1"), width)
    shared = overlap(F.col("c0").cast("double"), F.col("c1").cast("double"), F.col("s0").cast("double"), F.col("s1").cast("double"))
    most = both.where(shared > 0).groupBy(key, clip_id).agg(F.min_by("scene_idx", F.struct(-shared, "scene_idx")).alias("_a"))
    points = interval_join(clips.withColumn("_c", F.col("c0")), scenes, key, ("c0", "s0"), ("_c", "s1"), width)
    holds = points.where((F.col("s0") <= F.col("c0")) & (F.col("c0") < F.col("s1"))).groupBy(key, clip_id).agg(F.min("scene_idx").alias("_b"))
    same = scenes.select(F.col(key).alias("_k"), F.col("scene_idx").alias("_c")).distinct()
    out = clips.join(most, [key, clip_id], "left").join(holds, [key, clip_id], "left").join(same, (clips[key] == F.col("_k")) & (clips["c0"] == F.col("_c")), "left")
    return out.select(key, clip_id, F.coalesce("_a", "_b", "_c").alias("scene_idx"))


def pick_window(starts: DataFrame, windows: DataFrame, key: str, span_id: str) -> DataFrame:
    """starts with window_start and window_end: of a span's overlapping windows the one it shares most with, the first of equal ones; else the one whose middle is nearest.

    starts: key, span_id, s0, s1. windows: key, nth, c0, c1. Windows of a key are few, as scenes of a film are, so middles are compared directly.
    """
    w = windows.withColumnRenamed(key, "_k")
    both = starts.join(w, starts[key] == w["_k"])
    over = (F.col("c1") > F.col("s0")) & (F.col("c0") < F.col("s1"))
    shared = F.least("c1", "s1") - F.greatest("c0", "s0")
    middle = F.abs((F.col("c0") + F.col("c1")) / 2 - (F.col("s0") + F.col("s1")) / 2)
    order = F.struct(~over, F.when(over, -shared).otherwise(middle), "nth")
    best = both.groupBy(F.col(key).alias("_k"), F.col(span_id).alias("_id")).agg(F.min_by(F.struct("c0", "c1"), order).alias("_w"))
    return starts.join(best, (starts[key] == F.col("_k")) & (starts[span_id] == F.col("_id")), "left").select(*starts.columns, F.col("_w.c0").alias("window_start"), F.col("_w.c1").alias("window_end"))


def quality_rank(quality: Column) -> Column:
    """2 for full, 1 for partial, 0 for any other anchor."""
    return F.greatest(F.array_position(F.array(*[F.lit(q) for q in QUALITY]), F.coalesce(quality, F.lit(""))) - 1, F.lit(0))
