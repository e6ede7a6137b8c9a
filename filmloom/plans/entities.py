"""Queries on names, times and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions import names, temporal
from filmloom.operators import entities, grading, sequences
from filmloom.plans.registry import query
from filmloom.session import table

_STEM = "CASE " + " ".join(f"WHEN length(w) > {len(s) + 2} AND suffix(w, '{s}') THEN left(w, length(w) - {len(s)})" for s in names.SUFFIXES) + " ELSE w END"


@query("clean_text", r"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS t FROM documents)")
def clean_text(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", names.clean_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query("plain_fields", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || '/' || p_type || '!'), '[^a-z0-9]+', ' ', 'g')) AS field FROM part")
def plain_fields(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", names.plain_field(F.concat("p_brand", F.lit("/"), "p_type", F.lit("!"))).alias("field"))


@query("entity_keys", r"""SELECT c_custkey, upper(trim(regexp_replace(regexp_replace('Dr. "' || c_name || '" (' || c_mktsegment || ')', '\(.*?\)', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS entity FROM customer""")
def entity_keys(spark, d: str) -> DataFrame:
    name = F.concat(F.lit('Dr. "'), "c_name", F.lit('" ('), "c_mktsegment", F.lit(")"))
    return table(spark, d, "customer").select("c_custkey", names.entity_key(name).alias("entity"))


@query("relation_types", "SELECT p_partkey, CASE WHEN regexp_matches(r, '^[0-9]') THEN 'REL_' || r WHEN r = '' THEN 'RELATED_TO' ELSE r END AS relation FROM (SELECT p_partkey, trim(regexp_replace(upper(p_size || ' of-' || p_type), '[^A-Z0-9]+', '_', 'g'), '_') AS r FROM part)")
def relation_types(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", names.relation_type(F.concat(F.col("p_size").cast("string"), F.lit(" of-"), "p_type")).alias("relation"))


@query("word_stems", f"SELECT stem, count(*) AS n FROM (SELECT {_STEM} AS stem FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS w FROM documents)) GROUP BY stem")
def word_stems(spark, d: str) -> DataFrame:
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(low, F.lit("([a-z]+)"), 1)).alias("w"))
    return words.groupBy(names.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


@query("clock_times", "SELECT l_orderkey, l_linenumber, sum(h)::BIGINT AS n_hours, max(CASE WHEN h > 0 THEN printf('%d:%02d:%02d', h, m, s) ELSE printf('%d:%02d', m, s) END) AS last FROM (SELECT l_orderkey, l_linenumber, (t // 3600)::BIGINT AS h, (t % 3600 // 60)::BIGINT AS m, (t % 60)::BIGINT AS s FROM (SELECT *, floor(l_extendedprice)::BIGINT AS t FROM lineitem)) GROUP BY ALL")
def clock_times(spark, d: str) -> DataFrame:
    t = F.floor("l_extendedprice").cast("double")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(t / 3600).alias("h"), temporal.clock(t).alias("c"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.sum("h").alias("n_hours"), F.max("c").alias("last"))


@query("seconds_per_shot", "SELECT p_partkey, round(CASE WHEN p_size - 5 > 0 AND p_partkey % 50 > 1 THEN (p_size - 5) * 60.0::DOUBLE / (p_partkey % 50) ELSE 8.0::DOUBLE END, 6) AS seconds FROM part")
def seconds_per_shot(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(temporal.seconds_per_shot(F.col("p_size") - 5, F.col("p_partkey") % 50), 6).alias("seconds"))


@query("grade_threshold", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice / 500000 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
g AS (SELECT o_custkey AS k, avg(s) AS avg_score, count(*) AS n, count(*) FILTER (s >= 0.8) AS over FROM r GROUP BY 1)
SELECT o_custkey, o_orderkey, rank, round(avg_score, 6) AS avg_score, (avg_score < 0.8 AND CASE WHEN over > 0 THEN over ELSE least(n, 3) END < 2) AS needs_rewrite
FROM r JOIN g ON o_custkey = k WHERE CASE WHEN over > 0 THEN s >= 0.8 ELSE rank <= 3 END""")
def grade_threshold(spark, d: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 500000).alias("s"), F.row_number().over(best).cast("long").alias("rank"))
    return grading.grade(rows, "o_custkey", "rank", "s", 0.8).select("o_custkey", "o_orderkey", "rank", F.round("avg_score", 6).alias("avg_score"), "needs_rewrite")


@query("groups_of_entity", "SELECT l_suppkey, o_orderpriority, count(DISTINCT o_orderkey) AS scene_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def groups_of_entity(spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey")).join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return grading.groups_of_entity(rows, "l_suppkey", "o_orderpriority", "o_orderkey")


@query("keyframe_thinning", """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, place FROM e WHERE n <= 7 OR place IN (SELECT floor(i * n / 7.0)::BIGINT FROM range(7) t(i))""")
def keyframe_thinning(spark, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, d, "events").select("user_id", "event_id", nth.cast("long").alias("place"))
    return sequences.thin(rows, "user_id", "place", 7)


@query("text_matches_any", "SELECT p_partkey, (contains(t, 'brand') OR contains(t, 'steel')) AS hit FROM (SELECT p_partkey, trim(regexp_replace(lower(p_brand || '-' || p_type), '[^a-z0-9_]+', ' ', 'g')) AS t FROM part)")
def text_matches_any(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", sequences.matches_any(F.concat("p_brand", F.lit("-"), "p_type"), F.array(F.lit("Brand!"), F.lit("STEEL"))).alias("hit"))


@query("min_duration_refine")
def min_duration_refine(spark, d: str) -> DataFrame:
    """Of each order's ship days since its first, those at least ten days after the last one kept. A fold has no plain SQL; a worked case tests it."""
    day = F.datediff("l_shipdate", F.lit("2020-01-01")).cast("double")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(day)).alias("days"))
    days = F.transform("days", lambda x: x - F.col("days")[0])
    return rows.select("l_orderkey", sequences.min_duration(days, F.array_max(days) + 1, 10.0).alias("kept"))


_LIST = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_D_NAMES = f"""r AS (SELECT g, name, ws, list_filter(ws, lambda w: w NOT IN {_LIST(entities.WEAK)}) AS strong, key FROM (SELECT g, name, upper(name) AS key, string_split(upper(name), ' ') AS ws FROM n))"""
_RANKED = "SELECT g, canonical, arg_min(name, {'a': -len(string_split(sig, ' ')), 'b': -length(sig), 'c': -(length(name) - off), 'd': name}) AS preferred, count(*) AS n_aliases FROM c GROUP BY g, canonical"


@query("entity_canonical", f"WITH n AS (SELECT DISTINCT source AS g, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [a-z]+)?')) AS name FROM documents WHERE source IS NOT NULL), {_D_NAMES}, s AS (SELECT g, name, key, list_filter(ws, lambda w: w NOT IN {_LIST(entities.LEFT_OUT['Character'])}) AS ws FROM r WHERE NOT (len(strong) > 0 AND len(list_filter(strong, lambda w: w NOT IN {_LIST(entities.GENERIC['Character'])})) = 0)), t AS (SELECT g, name, key, array_to_string(CASE WHEN len(ws) > 1 THEN list_filter(ws, lambda w: length(w) > 1) ELSE ws END, ' ') AS j FROM s), u AS (SELECT g, name, CASE WHEN j = '' THEN key ELSE j END AS sig, CASE WHEN regexp_matches(upper(name), '^(DR|MR|MRS|MS)[ .]') THEN 6 ELSE 0 END AS off FROM t), d AS (SELECT DISTINCT g, sig, list_distinct(string_split(sig, ' ')) AS ws FROM u), m AS (SELECT g, w, min(sig) AS holder FROM (SELECT g, sig, unnest(ws) AS w FROM d WHERE len(ws) > 1) GROUP BY g, w HAVING count(*) = 1), c AS (SELECT u.g, name, sig, off, coalesce(holder, sig) AS canonical FROM u LEFT JOIN m ON m.g = u.g AND len(list_distinct(string_split(sig, ' '))) = 1 AND m.w = split_part(sig, ' ', 1)), b AS ({_RANKED}) SELECT c.g AS source, name, sig AS signature, c.canonical, preferred, n_aliases FROM c JOIN b ON b.g = c.g AND b.canonical = c.canonical")
def entity_canonical(spark, d: str) -> DataFrame:
    """Capitalised words of each source, with the word after them, as characters' names."""
    docs = table(spark, d, "documents")
    found = docs.select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [a-z]+)?"), F.lit(0))).alias("name"))
    return entities.resolve(found, "source", "name", "Character")


@query("entity_objects", f"WITH n AS (SELECT DISTINCT p_brand AS g, unnest([p_name, p_type || ' ' || p_name, 'the ' || p_name]) AS name FROM part), {_D_NAMES}, s AS (SELECT g, name, key, list_filter(ws, lambda w: w NOT IN {_LIST(entities.LEFT_OUT['Object'])}) AS ws FROM r WHERE NOT (len(strong) > 0 AND len(list_filter(strong, lambda w: w NOT IN {_LIST(entities.GENERIC['Object'])})) = 0)), c0 AS (SELECT g, name, CASE WHEN len(ws) = 0 THEN key ELSE array_to_string(ws, ' ') END AS sig, 0 AS off FROM s), d AS (SELECT DISTINCT g, sig, list_distinct(string_split(sig, ' ')) AS ws FROM c0), h AS (SELECT x.g, x.sig, min(y.sig) AS holder FROM d x JOIN d y ON y.g = x.g AND y.sig <> x.sig AND len(list_intersect(x.ws, y.ws)) = len(x.ws) GROUP BY x.g, x.sig, len(x.ws) HAVING count(*) = 1 AND min(len(string_split(y.sig, ' '))) <= len(x.ws) + 2), c AS (SELECT c0.g, name, c0.sig, off, coalesce(holder, c0.sig) AS canonical FROM c0 LEFT JOIN h ON h.g = c0.g AND h.sig = c0.sig), b AS ({_RANKED}) SELECT c.g AS p_brand, name, sig AS signature, c.canonical, preferred, n_aliases FROM c JOIN b ON b.g = c.g AND b.canonical = c.canonical")
def entity_objects(spark, d: str) -> DataFrame:
    """Parts of each brand under their name, with an article, and with their type before it, as objects' names."""
    part = table(spark, d, "part")
    forms = F.array("p_name", F.concat_ws(" ", "p_type", "p_name"), F.concat(F.lit("the "), F.col("p_name")))
    return entities.resolve(part.select("p_brand", F.explode(forms).alias("name")), "p_brand", "name", "Object")
