"""Registered queries on chunks: texts, layers, scenes, picks, cluster statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.functions import chunks as C
from filmloom.operators import search, segments, sequences
from filmloom.plans.queries import _D_E, _D_EV, events
from filmloom.plans.registry import query
from filmloom.plans.vectors import in_order
from filmloom.session import table

_D_CHUNK = "c AS (SELECT d.doc_id::VARCHAR AS chunk_id, source AS movie_id, d.doc_id * 2.0 AS start_seconds, CASE WHEN d.doc_id % 7 > 0 THEN d.doc_id * 2.0 + 2 END AS end_seconds, text AS description, lang AS situation, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN ' ' END AS vision_setting, CASE WHEN toxic = 1 THEN ['toxic', lang] ELSE [] END AS characters, CASE WHEN n_chars > 2000 THEN 'long' END AS narrative_arc, CASE WHEN d.doc_id % 5 = 0 THEN '[NO_DIALOGUE]' ELSE left(text, 40) END AS dialogue_text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def document_chunks(spark, d: str) -> DataFrame:
    """Documents with their labels as chunks."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    at, i = F.col("doc_id") * 2.0, F.col("doc_id")
    names = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), "lang")).otherwise(F.array().cast("array<string>"))
    return docs.select(
        i.cast("string").alias("chunk_id"), F.col("source").alias("movie_id"), at.alias("start_seconds"), F.when(i % 7 > 0, at + 2).alias("end_seconds"), F.col("text").alias("description"), F.col("lang").alias("situation"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, " ").alias("vision_setting"),
        names.alias("characters"), F.when(F.col("n_chars") > 2000, "long").alias("narrative_arc"), F.when(i % 5 == 0, "[NO_DIALOGUE]").otherwise(F.substring("text", 1, 40)).alias("dialogue_text"),
    )


_HAS = lambda c: f"(coalesce(len({c}) > 0, false))::INT" if c == "characters" else f"({c} IS NOT NULL)::INT" if c.endswith("seconds") else f"(coalesce(regexp_matches({c}, '\\S'), false))::INT"
_LACKING = {"vision_actions", "cast_in_scene", "causal_relations", "script_primary_heading", "screenplay_context_excerpt"}
_D_SHARE = ", ".join("(" + " + ".join("0" if f in _LACKING else _HAS(f) for f in fields) + f") / {len(fields)}.0 AS {n}" for n, fields in C.LAYER_FIELDS.items())


@query("chunk_layers", rf"WITH {_D_CHUNK}, s AS (SELECT *, {_D_SHARE} FROM c), q AS (SELECT *, round(" + " + ".join(f"{n} * {w}::DOUBLE" for n, w in C.LAYER_WEIGHTS.items()) + ", 4) AS quality_score, array_to_string([" + ", ".join(f"CASE WHEN {n} < 1 THEN '{n}' END" for n in C.LAYER_FIELDS) + "], ' ') AS missing_layers, array_to_string([" + ", ".join(f"'{f}'" if f in _LACKING else f"CASE WHEN {_HAS(f)} = 0 THEN '{f}' END" for f in C.CORE_FIELDS) + "], ' ') AS missing_fields FROM s) SELECT chunk_id, quality_score, missing_layers, missing_fields, CASE WHEN missing_layers = '' AND quality_score >= 0.9 THEN 'approved_auto' WHEN layer_1_temporal < 1 OR quality_score < 0.6 THEN 'needs_manual_review' WHEN layer_4_character < 1 OR layer_5_narrative_script < 1 THEN 'needs_enrichment' ELSE 'needs_review' END AS review_status FROM q")
def chunk_layers(spark, d: str) -> DataFrame:
    out = C.layered(document_chunks(spark, d))
    return out.select("chunk_id", "quality_score", F.array_join("missing_layers", " ").alias("missing_layers"), F.array_join("missing_fields", " ").alias("missing_fields"), "review_status")


@query("chunk_texts", rf"WITH {_D_CHUNK} SELECT chunk_id, md5(concat_ws(' | ', nullif(trim(description, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)), ''), nullif(trim(situation), ''), CASE WHEN dialogue_text NOT IN ('[PENDING_SRT_ALIGNMENT]', '[NO_DIALOGUE]') THEN nullif(trim(dialogue_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)), '') END, nullif(array_to_string(characters, ' '), ''), nullif(trim(vision_setting), ''), narrative_arc)) AS knowledge, md5(concat_ws(' | ', CASE WHEN lower(description) NOT IN ('', 'unspecified', 'none') THEN description ELSE situation END, narrative_arc, CASE WHEN lower(dialogue_text) NOT IN ('', 'unspecified', 'none') THEN dialogue_text END, CASE WHEN len(characters) > 0 THEN 'Characters: ' || array_to_string(characters[1:5], ', ') END)) AS benchmark FROM c")
def chunk_texts(spark, d: str) -> DataFrame:
    """Digests of the texts by which documents, as chunks, are searched and measured."""
    rows = document_chunks(spark, d)
    get = C.fields_of(rows)
    return rows.select("chunk_id", F.md5(C.knowledge_text(get)).alias("knowledge"), F.md5(C.benchmark_text(get)).alias("benchmark"))


@query("scene_similarity_groups", f"WITH {_D_E}, p AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM e), s AS (SELECT label, place, round(list_inner_product(v, lead(v) OVER (PARTITION BY label ORDER BY place)), 6) AS sim FROM p), g AS (SELECT *, sum(coalesce((prev < 0.1)::INT, 0)) OVER (PARTITION BY label ORDER BY place) AS scene FROM (SELECT *, lag(sim) OVER (PARTITION BY label ORDER BY place) AS prev FROM s)) SELECT label, scene::BIGINT AS scene, min(place) AS start, max(place) + 1 AS \"end\", round(avg(CASE WHEN sim >= 0.1 THEN sim END), 9) AS coherence FROM g GROUP BY label, scene")
def scene_similarity_groups(spark, d: str) -> DataFrame:
    """Each label's vectors in order of id cut where neighbours' similarity is below 0.1, as the tables' vectors lie far apart."""
    sims = segments.neighbour_similarity(in_order(spark, d), "label", "place", "embedding")
    return segments.scenes_by_similarity(sims, "label", "place", "sim", 0.1).withColumn("coherence", F.round("coherence", 9))


@query("scene_time_groups", f"WITH RECURSIVE {_D_EV}, o AS (SELECT user_id, t AS s, t + 60 AS e, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev), c AS (SELECT user_id, rn, 0 AS chunk, s AS start_s, e AS end_s FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, CASE WHEN end_s - start_s < 86400 THEN chunk ELSE chunk + 1 END, CASE WHEN end_s - start_s < 86400 THEN start_s ELSE s END, e FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1) SELECT user_id, chunk, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM c GROUP BY user_id, chunk")
def scene_time_groups(spark, d: str) -> DataFrame:
    """Each user's events joined up to the one that ends a day or more after the first."""
    return segments.scenes_by_time(events(spark, d).withColumn("e", F.col("t") + 60), "user_id", "t", "e", 86400.0)


@query("keyframe_picks", f"WITH {_D_EV}, f AS (SELECT user_id, floor(t / 10800)::BIGINT AS shot, event_id % 4 AS image, t, event_id FROM ev), s AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, min(t) AS s0, max(t) AS s1 FROM ev GROUP BY ALL) SELECT f.user_id, day, shot, arg_min(event_id, {{'o': CASE image WHEN 1 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 99 END, 'd': abs(t - (s0 + s1) / 2), 't': t}}) AS event_id FROM f JOIN s ON s.user_id = f.user_id AND t BETWEEN s0 AND s1 AND s1 > s0 GROUP BY f.user_id, day, shot")
def keyframe_picks(spark, d: str) -> DataFrame:
    """Events as frames of three-hour shots: one a shot for each of a user's days."""
    ev = events(spark, d)
    frames = ev.select("user_id", F.floor(F.col("t") / 10800).alias("shot"), (F.col("event_id") % 4).alias("image"), "t", "event_id")
    days = ev.groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.min("t").alias("s0"), F.max("t").alias("s1"))
    return sequences.pick_per_shot(frames, days, "user_id", "day", "shot", "image", "t", 86400.0).select("user_id", "day", "shot", "event_id")


@query("nn_cluster_stats", f"WITH {_D_E}, b AS (SELECT a.vec_id, max(round(list_inner_product(a.v, b.v), 4)) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT count(*) AS n_queries, round(avg(s), 4) AS mean_similarity, round(quantile_cont(s, 0.25), 4) AS p25, round(quantile_cont(s, 0.5), 4) AS p50, round(quantile_cont(s, 0.75), 4) AS p75 FROM b")
def nn_cluster_stats(spark, d: str) -> DataFrame:
    """How near each vector's nearest one of its label is, over all vectors of labels with two or more."""
    near = search.nearest_within(table(spark, d, "embeddings"), "label")
    at = lambda p: F.round(F.percentile("score", p), 4)
    return near.agg(F.count("*").alias("n_queries"), F.round(F.avg("score"), 4).alias("mean_similarity"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
