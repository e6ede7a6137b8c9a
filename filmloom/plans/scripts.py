"""Registered queries that align scripts and subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.functions import fuzzy
from filmloom.operators import anchors, subscenes
from filmloom.plans.queries import _D_EV, _D_SC, events
from filmloom.plans.registry import query
from filmloom.session import table
from filmloom.sources import screenplay


def as_subtitles(docs: DataFrame, each: int = 8, seconds: float = 3.0) -> DataFrame:
    """Documents as tracks of subtitles: doc_id, place, start_s, end_s, text of every `each` words, `seconds` long."""
    ws = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    cut = ws.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(each)), lambda i: F.array_join(F.slice("w", i, each), " "))).alias("place", "text"))
    return cut.withColumn("place", F.col("place").cast("long")).withColumn("start_s", F.col("place") * seconds).withColumn("end_s", F.col("start_s") + seconds)


@query("script_anchors")
def script_anchors(spark, d: str) -> DataFrame:
    """Where each benchmark item, as a dialogue, is spoken in each document that holds some of it."""
    asked = table(spark, d, "benchmark").select("item_id", fuzzy.candidates(F.array("text")).alias("texts"))
    found = anchors.find_anchors(asked, as_subtitles(table(spark, d, "documents")), "item_id", "doc_id", "place", gram=4, least=0.5)
    return found.withColumn("score", F.round("score", 4))


_D_LINES = "raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN pos || ' INT. ' || left(line, 30) WHEN pos % 7 IN (2, 4) THEN repeat(' ', 14) || upper(regexp_extract(line, '[A-Za-z]+')) WHEN pos % 7 = 5 THEN repeat(' ', 9) || line ELSE line END AS line FROM raw)"
_D_SP = r"'^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$'"


@query("screenplay_blocks", rf"WITH {_D_LINES}, a AS (SELECT doc_id, pos, line, regexp_replace(line, {_D_SP}, '', 'g') AS t, length(line) - length(regexp_replace(line, '^[\s\x0B\x{{85}}\p{{Z}}]+', '')) AS ind, pos % 7 = 0 AND regexp_matches(line, '(?i)^\s*(\d+)?\s*(INT\.?)\s*[\.\-\s].{{2,}}') AS heading FROM l), b AS (SELECT *, NOT heading AND ind BETWEEN 10 AND 45 AND t = upper(t) AND regexp_matches(t, '[A-Z]') AND length(t) <= 42 AND len(regexp_split_to_array(t, '\s+')) <= 5 AND (NOT contains(substr(t, 2), '.') OR contains(t, '(')) AS name FROM a), c AS (SELECT *, sum(heading::INT) OVER w AS scene, sum((heading OR name)::INT) OVER w AS part FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), d AS (SELECT *, max(CASE WHEN name THEN t END) OVER p AS who, min(CASE WHEN t <> '' AND NOT name AND NOT heading AND ind < 8 THEN pos END) OVER p AS ends FROM c WINDOW p AS (PARTITION BY doc_id, part)), k AS (SELECT *, CASE WHEN heading THEN 'SceneHeading' WHEN who IS NOT NULL AND (ends IS NULL OR pos < ends) THEN 'Dialogue' ELSE 'Action' END AS kind FROM d WHERE t <> '' AND NOT name) SELECT doc_id, min(pos) AS at, kind, max(CASE WHEN kind = 'Dialogue' THEN who END) AS character, md5(CASE WHEN kind = 'SceneHeading' THEN regexp_replace(min(t), '^\d+\s*', '') ELSE string_agg(t, ' ' ORDER BY pos) END) AS digest, max(CASE WHEN kind = 'SceneHeading' THEN pos END)::INT AS scene_num, max(scene)::BIGINT AS scene FROM k GROUP BY doc_id, part, kind")
def screenplay_blocks(spark, d: str) -> DataFrame:
    """Documents set as screenplays - every seventh line a heading, others names and speech - parsed into blocks."""
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    turn = F.col("at") % 7
    name = F.concat(F.repeat(F.lit(" "), F.lit(14)), F.upper(F.regexp_extract("line", "[A-Za-z]+", 0)))
    line = F.when(turn == 0, F.concat(F.col("at").cast("string"), F.lit(" INT. "), F.substring("line", 1, 30))).when(turn.isin(2, 4), name).when(turn == 5, F.concat(F.repeat(F.lit(" "), F.lit(9)), "line")).otherwise(F.col("line"))
    found = screenplay.blocks(each.select("doc_id", F.col("at").cast("long").alias("place"), line.alias("line")), "doc_id")
    return found.select("doc_id", "at", "kind", "character", F.md5("text").alias("digest"), "scene_num", "scene")


_D_SUB = (
    f"WITH {_D_EV}, {_D_SC}, s AS (SELECT user_id AS movie_id, 's' || lpad((day + 1)::VARCHAR, 5, '0') AS scene_id, s0, s1, day FROM sc), p AS (SELECT user_id AS movie_id, floor((t + 5000) / 40000)::BIGINT AS nth, min(t) AS c0, max(t) AS c1 FROM ev WHERE event_id % 3 > 0 GROUP BY ALL), "
    "k AS (SELECT user_id AS movie_id, floor(t / 20000)::BIGINT AS nth, min(t) AS k0, max(t) AS k1 FROM ev GROUP BY ALL), "
    "o AS (SELECT s.*, p.nth, c0, c1 FROM s JOIN p ON p.movie_id = s.movie_id AND c1 > s0 AND c0 < s1), n AS (SELECT * FROM (SELECT s.*, p.nth, c0, c1 FROM s JOIN p ON p.movie_id = s.movie_id WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.movie_id = s.movie_id AND o.scene_id = s.scene_id)) QUALIFY row_number() OVER (PARTITION BY movie_id, scene_id ORDER BY abs(c0 - s0), nth) = 1), "
    "a AS (SELECT *, greatest(s0, c0) AS o0, least(s1, c1) AS o1, greatest(0, least(s1, c1) - greatest(s0, c0)) AS sec, CASE nth % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'linear' END AS q FROM (SELECT * FROM o UNION ALL SELECT * FROM n)), "
    "c AS (SELECT a.movie_id, scene_id, a.nth, arg_min('k' || k.nth, {'u': k.nth // 2 <> a.nth, 'o': -greatest(0, least(k1, o1) - greatest(k0, o0)), 'd': abs(k0 - o0), 'e': abs(k1 - o1), 'n': k.nth}) AS parent FROM a JOIN k ON k.movie_id = a.movie_id AND k.nth % 3 = day % 3 GROUP BY ALL), "
    "r AS (SELECT a.*, coalesce(parent, '') AS parent, round(sec, 2) AS overlap_seconds, sec >= 5 OR q <> 'linear' AS ok, round(sec / greatest(c1 - c0, 1), 3) AS ratio FROM a LEFT JOIN c ON c.movie_id = a.movie_id AND c.scene_id = a.scene_id AND c.nth = a.nth), "
    "f AS (SELECT *, count(*) OVER w AS split_count, row_number() OVER (PARTITION BY movie_id, nth ORDER BY ok DESC, overlap_seconds DESC, ratio DESC, round(o0, 2), scene_id) = 1 AS best FROM r WINDOW w AS (PARTITION BY movie_id, nth)) "
)


@query("script_subscenes", _D_SUB + "SELECT movie_id, scene_id, 'u' || nth AS uid, parent AS parent_chunk_id, overlap_seconds, ratio AS overlap_ratio_script, split_count, best AS is_canonical, best AND ok AS indexable FROM f")
def script_subscenes(spark, d: str) -> DataFrame:
    """Users as films: days as scenes, stretches of 11 hours as script scenes, shorter ones as chunks."""
    ev = events(spark, d).withColumnRenamed("user_id", "movie_id")
    span = lambda n, a, b: ev.groupBy("movie_id", n.alias("nth")).agg(F.min("t").alias(a), F.max("t").alias(b))
    days = span(F.floor(F.col("t") / 86400), "s0", "s1").withColumn("scene_id", F.concat(F.lit("s"), F.lpad((F.col("nth") + 1).cast("string"), 5, "0")))
    scripts = ev.where("event_id % 3 > 0").groupBy("movie_id", F.floor((F.col("t") + 5000) / 40000).alias("nth")).agg(F.min("t").alias("c0"), F.max("t").alias("c1"))
    turn = F.col("nth") % 4
    scripts = scripts.select("movie_id", "nth", "c0", "c1", F.concat(F.lit("u"), "nth").alias("uid"), F.lit("h").alias("heading"), F.when(turn == 0, "full").when(turn == 1, "partial").otherwise("linear").alias("anchor_quality"), F.lit(0.5).alias("confidence"))
    clips = days.select("movie_id", "scene_id", F.concat(F.lit("c"), F.col("nth") % 3).alias("clip_id"), F.lit(0).alias("nth"), F.lit("d").alias("description"))
    chunks = span(F.floor(F.col("t") / 20000), "k0", "k1").select("movie_id", F.concat(F.lit("k"), "nth").alias("chunk_id"), "nth", F.concat(F.lit("c"), F.col("nth") % 3).alias("clip_id"), F.concat(F.lit("u"), F.floor(F.col("nth") / 2)).alias("uid"), "k0", "k1")
    out = subscenes.subscenes(days.select("movie_id", "scene_id", "s0", "s1", F.lit("d").alias("description")), scripts, clips, chunks, width=43200.0)
    return out.select("movie_id", "scene_id", "uid", "parent_chunk_id", "overlap_seconds", "overlap_ratio_script", "split_count", "is_canonical", "indexable")
