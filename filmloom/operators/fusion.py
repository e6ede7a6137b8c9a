"""Hits of two rankers fused into scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hits of a ranker that count, scenes of an answer, subscenes that a scene shows.
HITS, SCENES, SUBSCENES = 12, 6, 4
#: Columns that tell a hit's scene, the first that is set, with the kind and the prefix that keeps the kinds' ids apart.
IDENTITY = (("script_scene_uid", "script_scene"), ("parent_scene_id", "semantic_scene"), ("subscene_id", "script_subscene"), ("chunk_id", "chunk"), ("clip_id", "clip"))


def _set(c: str) -> Column:
    """The column as text, null if it is empty."""
    return F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))


def scene_of(rank: str, source: str) -> tuple[Column, Column]:
    """(id, kind) of a hit's scene: its group, else the first of IDENTITY, else itself alone."""
    own = [(F.concat(F.lit(f"{kind}::"), _set(c)), F.when(_set(c).isNotNull(), kind)) for c, kind in IDENTITY]
    alone = F.concat(F.col(source), F.lit("::"), F.col(rank).cast("string"))
    group = _set("scene_group_id")
    kind = F.when(group.isNotNull(), F.coalesce(_set("scene_group_type"), F.lit("scene")))
    return F.coalesce(group, *[i for i, _ in own], alone), F.coalesce(kind, *[k for _, k in own], F.lit("candidate"))


def fuse(hits: DataFrame, query: str, weights: tuple[float, float] = (0.6, 0.4), limit: int = SCENES) -> DataFrame:
    """query, place, id, kind, score and what its hits tell of each query's best scenes.

    hits: query, source ("visual" or "script"), rank (from 0 in its source), score, scene_score, the columns of IDENTITY,
    scene_group_id, scene_group_type, movie_id, heading, location, start_s, end_s, characters, script_characters, path, cue.
    Only a source's first HITS hits count. A scene's score is the weighted sum of its best visual and best script score,
    or its best scene score if that is more. Scenes are in order of score, best visual, best script score, numbers of visual and
    of script hits, then of their first hit. Text is taken from the first hit that has one, visual hits first; the frame
    from the last of the best visual hits; times span all hits; ids, names, frames and cues are each listed once, names, frames and cues from visual hits, but for script_characters. A query
    has at most two times HITS hits after the first step, so what is gathered is bounded. Null scores count as 0.
    """
    scene, kind = scene_of("rank", "source")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    few = hits.where(F.col("rank") < HITS).withColumns({"_scene": scene, "_kind": kind, "_at": F.struct((F.col("source") != "visual").alias("later"), F.col("rank").alias("rank")), "_score": zero("score")})
    visual = F.col("source") == "visual"
    none = F.array().cast("array<string>")
    hit = F.struct("_at", "source", "_score", *[_set(c).alias(c) for c in ("movie_id", "heading", "location", "path", "clip_id", "chunk_id", "script_scene_uid", "subscene_id")], "start_s", F.when(visual, _set("cue")).alias("cue"), F.when(visual & F.col("characters").isNotNull(), F.col("characters")).otherwise(none).alias("characters"), F.coalesce("script_characters", none).alias("script_characters"))
    agg = few.groupBy(query, "_scene").agg(
        F.min_by("_kind", "_at").alias("kind"), F.coalesce(F.max(F.when(visual, F.greatest("_score", F.lit(0.0)))), F.lit(0.0)).alias("best_visual"), F.coalesce(F.max(F.when(~visual, F.greatest("_score", F.lit(0.0)))), F.lit(0.0)).alias("best_script"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(visual, zero("scene_score"))), F.lit(0.0))).alias("best_scene"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        F.count_if(visual).alias("n_visual"), F.count_if(~visual).alias("n_script"), F.array_sort(F.collect_list(hit)).alias("_hits"),
    )
    score = F.greatest(weights[0] / sum(weights) * F.col("best_visual") + weights[1] / sum(weights) * F.col("best_script"), F.col("best_scene"))
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.desc("best_visual"), F.desc("best_script"), F.desc("n_visual"), F.desc("n_script"), F.col("_hits")[0]["_at"])) - 1
    ranked = agg.withColumn("score", score).withColumn("place", best).where(F.col("place") < limit)
    each = lambda c: F.array_compact(F.transform("_hits", lambda h: h[c]))
    first = lambda c: F.get(each(c), F.lit(0))
    once = lambda c: F.array_sort(F.array_distinct(c))
    names = lambda c: once(F.filter(F.flatten(F.transform("_hits", lambda h: h[c])), lambda x: x.isNotNull() & (x != "")))
    frames = F.filter("_hits", lambda h: (h["source"] == "visual") & h["path"].isNotNull())
    frame = F.array_max(F.transform(frames, lambda h: F.struct(h["_score"].alias("s"), h["_at"]["rank"].alias("r"), h["path"].alias("p"))))["p"]
    told = F.filter("_hits", lambda h: (h["source"] != "visual") & (h["heading"].isNotNull() | h["start_s"].isNotNull()))
    return ranked.select(
        query, "place", F.col("_scene").alias("id"), "kind", "score", "best_visual", "best_script", "start_s", "end_s", first("movie_id").alias("movie_id"), first("heading").alias("heading"), first("location").alias("location"), frame.alias("frame"),
        F.array_distinct(F.transform(frames, lambda h: h["path"])).alias("frames"), F.array_distinct(each("cue")).alias("cues"), once(each("clip_id")).alias("clip_ids"), once(each("chunk_id")).alias("chunk_ids"), once(each("script_scene_uid")).alias("script_scene_uids"), once(each("subscene_id")).alias("subscene_ids"),
        names("characters").alias("characters"), names("script_characters").alias("script_characters"), F.slice(F.transform(told, lambda h: h["subscene_id"]), 1, SUBSCENES).alias("subscenes"), (F.col("n_visual") + F.col("n_script")).alias("evidence_count"),
    )
