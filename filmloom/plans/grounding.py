"""Queries on questions about time, excerpts and merged hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.functions import excerpts, questions
from filmloom.operators import grounding, hits
from filmloom.plans.registry import query
from filmloom.session import table

_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ')"


def _questions(spark, d: str) -> DataFrame:
    """A question for each part, of one of nine forms."""
    size, form = F.col("p_size").cast("string"), F.col("p_partkey") % 9
    asked = F.when(form == 0, F.concat(F.lit("What is shown at 1:"), F.lpad(size, 2, "0"), F.lit(":05?"))).when(form == 1, F.concat(F.lit("Look AT "), size, F.lit(" minutes")))
    asked = asked.when(form == 2, F.concat(F.lit("stop at "), size, F.lit(".5 hours"))).when(form == 3, F.lit("the first time we see Neo Jones appear")).when(form == 4, F.lit("who saw it last time we saw Brand"))
    asked = asked.when(form == 5, F.lit("before Storm happens")).when(form == 6, F.lit("during the Battle")).when(form == 7, F.lit("When does Rain show?")).otherwise(F.lit("who is here"))
    return table(spark, d, "part").select("p_partkey", "p_size", "p_name", asked.alias("asked"))


@query("temporal_expressions", """
SELECT p_partkey, CASE f WHEN 0 THEN 'at_time' WHEN 1 THEN 'at_time' WHEN 2 THEN 'at_time' WHEN 3 THEN 'first_occurrence' WHEN 4 THEN 'last_occurrence' WHEN 5 THEN 'before_event' WHEN 6 THEN 'during_event' WHEN 7 THEN 'any_occurrence' END AS kind,
 CASE f WHEN 0 THEN 3605.0::DOUBLE + 60 * p_size WHEN 1 THEN 60.0::DOUBLE * p_size WHEN 2 THEN 0.5::DOUBLE + p_size END AS seconds,
 CASE f WHEN 3 THEN 'Neo Jones' WHEN 4 THEN 'Brand' WHEN 5 THEN 'Storm' WHEN 6 THEN 'Battle' WHEN 7 THEN 'Rain' END AS entity,
 (CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 3 THEN 0.9 WHEN 4 THEN 0.9 WHEN 5 THEN 0.85 WHEN 6 THEN 0.8 WHEN 7 THEN 0.85 END)::DOUBLE AS confidence
FROM (SELECT *, p_partkey % 9 AS f FROM part)""")
def temporal_expressions(spark, d: str) -> DataFrame:
    return _questions(spark, d).withColumn("e", questions.expression(F.col("asked"))).select("p_partkey", "e.kind", "e.seconds", "e.entity", "e.confidence")


@query("truncate_text", f"""
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(trim(regexp_replace(left(t, 200), ' [^ ]*$', ''), ' '), '\\.+$', '') || '...' END AS excerpt
FROM (SELECT doc_id, {_CLEAN} AS t FROM documents)""")
def truncate_text(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", excerpts.truncate_text(F.col("text"), 200).alias("excerpt"))


@query("sentences", rf"""
SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest
FROM (SELECT doc_id, list_filter(string_split(replace(regexp_replace(regexp_replace(t, '\b(Mr|Mrs|Ms|Dr)\. ', '\1<DOT> ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), '<DOT>', '.'), chr(10)), lambda x: x <> '') AS s
FROM (SELECT doc_id, {_CLEAN} AS t FROM documents))""")
def sentences(spark, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", excerpts.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("best_hit_merge", """
WITH h AS (SELECT l_partkey, l_quantity::DOUBLE AS s, l_returnflag AS src, l_orderkey * 10 + l_linenumber AS o FROM lineitem),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, o) = 1),
m AS (SELECT DISTINCT b.l_partkey FROM b JOIN h ON b.l_partkey = h.l_partkey AND h.o > b.o AND h.src <> b.src)
SELECT b.l_partkey, b.s AS score, b.o AS place, CASE WHEN m.l_partkey IS NULL THEN b.src ELSE 'hybrid' END AS source FROM b LEFT JOIN m ON b.l_partkey = m.l_partkey""")
def best_hit_merge(spark, d: str) -> DataFrame:
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("source"), place.alias("place"))
    return hits.best_hits(rows, "l_partkey", "score", "source", "place")


@query("upsert_partition", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'P'""")
def upsert_partition(spark, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return hits.upsert(orders, orders.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("new")), "o_custkey")


@query("quota_leftovers", """
WITH r AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
f AS (SELECT * FROM r WHERE rank > 20 ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey LIMIT 103 - (SELECT count(*) FROM r WHERE rank <= 20))
SELECT o_orderpriority, o_orderkey, rank FROM r WHERE rank <= 20 UNION ALL SELECT o_orderpriority, o_orderkey, rank FROM f""")
def quota_leftovers(spark, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return hits.quota_with_leftovers(rows, "o_orderpriority", 5, "o_totalprice", "o_orderkey", 103).select("o_orderpriority", "o_orderkey", "rank")


_D_SPANS = "SELECT l_partkey, l_orderkey * 10 + l_linenumber AS nth, l_quantity * 60.0 AS a, l_quantity * 60.0 + 30 + l_linenumber * 20 AS b, l_discount * 8 AS rel, l_extendedprice AS price FROM lineitem"


def _spans(spark, d: str) -> DataFrame:
    """Lines of a part as spans of a film."""
    a = F.col("l_quantity") * 60.0
    nth = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), nth.alias("nth"), a.alias("start_s"), (a + 30 + F.col("l_linenumber") * 20).alias("end_s"), (F.col("l_discount") * 8).alias("relevance"), "l_extendedprice")


@query("temporal_grounding", f"""
WITH q AS (SELECT p_partkey, f, CASE f WHEN 0 THEN 3605.0 + 60 * p_size WHEN 1 THEN 60.0 * p_size WHEN 2 THEN 0.5 + p_size END AS sought, CASE WHEN f < 3 THEN 'at_time' WHEN f = 3 THEN 'first_occurrence' WHEN f = 4 THEN 'last_occurrence' WHEN f = 5 THEN 'before_event' WHEN f = 6 THEN 'during_event' WHEN f = 7 THEN 'any_occurrence' END AS kind FROM (SELECT *, p_partkey % 9 AS f FROM part)),
l AS ({_D_SPANS}),
s AS (SELECT q.*, l.*, (CASE WHEN f < 3 THEN CASE WHEN sought BETWEEN a AND b THEN 1 ELSE greatest(0, 1 - least(abs(a - sought), abs(b - sought)) / 300) END WHEN f = 3 THEN CASE WHEN a < 60 THEN 1 ELSE greatest(0.2, 1 - a / 7200) END WHEN f = 4 THEN least(1, a / 7200 + 0.3) WHEN f IN (5, 6) THEN 0.6 WHEN f = 7 THEN 0.5 ELSE CASE WHEN b - a > 0 AND b - a <= 120 THEN 1 ELSE greatest(0.5, 1 - (b - a - 120) / 120) END END)::DOUBLE AS tm FROM q JOIN l ON l_partkey = p_partkey),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY tm * 0.6 + rel * 0.4 DESC, nth) = 1)
SELECT q.p_partkey, q.kind, coalesce(a, 0)::DOUBLE AS start_s, coalesce(b, 60)::DOUBLE AS end_s, coalesce(round(tm * rel, 3), 0)::DOUBLE AS confidence, coalesce(tm * rel >= 0.3, false) AS grounded FROM q LEFT JOIN t ON t.p_partkey = q.p_partkey""")
def temporal_grounding(spark, d: str) -> DataFrame:
    """Each part's question about time, answered by one of its lines."""
    cands = _spans(spark, d).withColumns({"description": F.lit(""), "names": F.array().cast("array<string>"), "event_start": F.lit(None).cast("double")})
    out = grounding.ground(_questions(spark, d).withColumnRenamed("asked", "text"), cands, "p_partkey")
    return out.select("p_partkey", "kind", "start_s", "end_s", "confidence", "grounded")


@query("grounding_metrics", f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY price DESC, nth) AS rank FROM ({_D_SPANS})),
i AS (SELECT l_partkey, rank, greatest(0, least(b, p_size * 60.0 + 200) - greatest(a, p_size * 60.0)) / (greatest(b, p_size * 60.0 + 200) - least(a, p_size * 60.0)) AS iou FROM l JOIN part ON p_partkey = l_partkey WHERE rank <= 10),
g AS (SELECT *, min(CASE WHEN iou >= 0.5 THEN rank END) OVER (PARTITION BY l_partkey) AS good, max(rank) OVER (PARTITION BY l_partkey) AS last FROM i),
r AS (SELECT * FROM g WHERE good IS NULL OR rank <= good), p AS (SELECT l_partkey, sum(iou) AS s, count(*) AS n, any_value(good) AS good, any_value(coalesce(good, last)) AS stop FROM r GROUP BY l_partkey), c AS (SELECT count(*) AS n FROM part)
SELECT round(sum(s) / sum(p.n), 6) AS mean_iou, round(sum(1.0 / stop) / any_value(c.n), 6) AS mrr, round(count(good) / any_value(c.n), 6) AS recall, round(count(*) FILTER (WHERE good = 1) / count(good), 6) AS rank1_share, any_value(c.n) AS n_queries FROM p, c""")
def grounding_metrics(spark, d: str) -> DataFrame:
    """How well a part's dearest lines answer when its size says."""
    part = table(spark, d, "part")
    top = grounding.ranked_by(_spans(spark, d), "p_partkey", "l_extendedprice", "nth", 10)
    rows = top.join(part.select("p_partkey", (F.col("p_size") * 60.0).alias("true_start"), (F.col("p_size") * 60.0 + 200).alias("true_end")), "p_partkey")
    out = grounding.grounding_metrics(rows, part.count(), "p_partkey", "rank")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_iou", "mrr", "recall", "rank1_share")], "n_queries")
