"""Registered queries on retrieval, cues and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions import temporal
from filmloom.functions.vectors import dot, doubles
from filmloom.operators import search, timeline
from filmloom.plans.queries import _D_E, _D_EV, _D_SC, events, graph_edges_distinct, scenes
from filmloom.plans.registry import query
from filmloom.session import table


@query("hierarchical_search", f"WITH {_D_E}, q AS (SELECT v AS q FROM e WHERE vec_id = 0), s AS (SELECT label, vec_id, round(list_inner_product(v, q), 4) AS sim FROM e, q), g AS (SELECT label, round(avg(sim), 4) AS scene FROM s GROUP BY label ORDER BY scene DESC, label LIMIT 3) SELECT label, vec_id, sim, scene, round(0.7 * sim + 0.3 * scene, 6) AS score FROM s JOIN g USING (label)")
def hierarchical_search(spark, d: str) -> DataFrame:
    """Frames of the three best scenes; a scene scores as its mean vector does."""
    rows = table(spark, d, "embeddings")
    q = rows.where("vec_id = 0").select(doubles(F.col("embedding")).alias("q")).limit(1)
    sim = rows.join(F.broadcast(q)).select("label", "vec_id", F.round(dot(doubles(F.col("embedding")), F.col("q")), 4).alias("sim"))
    best = sim.groupBy("label").agg(F.round(F.avg("sim"), 4).alias("scene")).orderBy(F.desc("scene"), "label").limit(3)
    return sim.join(F.broadcast(best), "label").withColumn("score", F.round(0.7 * F.col("sim") + 0.3 * F.col("scene"), 6))


@query("nn_within_group", f"WITH {_D_E} SELECT a.vec_id, b.vec_id AS nearest, round(list_inner_product(a.v, b.v), 4) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) = 1")
def nn_within_group(spark, d: str) -> DataFrame:
    return search.nearest_within(table(spark, d, "embeddings"), "label")


@query("lexical_bonus_rank", "WITH q AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark ORDER BY item_id LIMIT 1), s AS (SELECT doc_id, source, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), q)) / len(q) + CASE WHEN source = (SELECT min(source) FROM documents) THEN 0.05 ELSE 0 END AS x FROM documents, q) SELECT doc_id, source, round(x, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def lexical_bonus_rank(spark, d: str) -> DataFrame:
    """The 20 documents that hold most of the first benchmark item's words, with a bonus for the preferred source."""
    docs = table(spark, d, "documents")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
    asked = table(spark, d, "benchmark").orderBy("item_id").limit(1).select(words("text").alias("q"))
    asked = asked.join(docs.agg(F.min("source").alias("preferred")))
    share = F.size(F.array_intersect(words("text"), F.col("q"))) / F.size("q")
    score = share + F.when(F.col("source") == F.col("preferred"), 0.05).otherwise(0.0)
    return docs.join(F.broadcast(asked)).select("doc_id", "source", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


_D_CUE = f"{_D_EV}, k AS (SELECT event_id, user_id, t AS s0, t + 3600 AS s1 FROM ev), c AS (SELECT event_id AS cue_id, user_id, t + 4000 AS c0, t + 7000 AS c1 FROM ev)"


@query("interval_join_ratio_fallback", f"WITH {_D_CUE}, o AS (SELECT event_id, cue_id, c0 FROM k JOIN c ON k.user_id = c.user_id AND c1 >= s0 AND c0 <= s1 AND (greatest(0, least(c1, s1) - greatest(c0, s0)) >= 0.3 * greatest(s1 - s0, 1) OR greatest(0, least(c1, s1) - greatest(c0, s0)) >= 600)), f AS (SELECT event_id, cue_id, c0 FROM k JOIN c ON k.user_id = c.user_id AND abs(c0 - s0) < 5000 WHERE event_id NOT IN (SELECT event_id FROM o)) SELECT event_id, string_agg(cue_id::VARCHAR, ' ' ORDER BY c0, cue_id) AS cues FROM (FROM o UNION ALL FROM f) GROUP BY event_id")
def interval_join_ratio_fallback(spark, d: str) -> DataFrame:
    ev = events(spark, d)
    chunks = ev.select("event_id", "user_id", F.col("t").alias("s0"), (F.col("t") + 3600).alias("s1"))
    cues = ev.select("user_id", F.col("event_id").alias("cue_id"), (F.col("t") + 4000).alias("c0"), (F.col("t") + 7000).alias("c1"), F.col("event_id").cast("string").alias("text"))
    return timeline.cue_text(chunks, cues, "user_id", "event_id", 0.3, 600.0, 5000.0, 7200.0).select("event_id", "cues")


@query("scene_transition", "WITH n AS (SELECT conv_id, turn, text, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)) SELECT conv_id, turn, before, after FROM n WHERE contains(text, ',')")
def scene_transition(spark, d: str) -> DataFrame:
    """What comes before and after each turn that holds a comma."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    near = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
    return near.where(F.col("text").contains(",")).drop("text")


@query("temporal_score_at_time", f"WITH {_D_EV}, {_D_SC}, x AS (SELECT user_id, day, s0 - day * 86400 AS a, s1 - day * 86400 AS b FROM sc) SELECT user_id, day, round(CASE WHEN 3000 BETWEEN a AND b THEN 1 ELSE greatest(0, 1 - least(abs(a - 3000), abs(b - 3000)) / 300) END, 6) AS at_time, round(CASE WHEN a < 60 THEN 1 ELSE greatest(0.2, 1 - a / 7200) END, 6) AS first_score, round(least(1, a / 7200 + 0.3), 6) AS last_score, round(CASE WHEN b - a > 0 AND b - a <= 120 THEN 1 ELSE greatest(0.5, 1 - (b - a - 120) / 120) END, 6) AS plain FROM x")
def temporal_score_at_time(spark, d: str) -> DataFrame:
    of_day = lambda c: F.col(c) - F.col("day") * 86400
    x = scenes(spark, d).select("user_id", "day", of_day("s0").alias("a"), of_day("s1").alias("b"))
    a, b = F.col("a"), F.col("b")
    scores = {"at_time": temporal.at_time(a, b, 3000), "first_score": temporal.first_occurrence(a, F.lit("")), "last_score": temporal.last_occurrence(a), "plain": temporal.usual_length(a, b)}
    return x.select("user_id", "day", *[F.round(c, 6).alias(n) for n, c in scores.items()])


@query("greedy_chunks", f"WITH RECURSIVE {_D_EV}, o AS (SELECT user_id, t AS s, t + 60 AS e, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev), c AS (SELECT user_id, rn, 0 AS chunk, s AS start_s, e AS end_s FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, CASE WHEN greatest(end_s, e) - start_s <= 21600 THEN chunk ELSE chunk + 1 END, CASE WHEN greatest(end_s, e) - start_s <= 21600 THEN start_s ELSE s END, CASE WHEN greatest(end_s, e) - start_s <= 21600 THEN greatest(end_s, e) ELSE e END FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1) SELECT user_id, chunk, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM c GROUP BY user_id, chunk")
def greedy_chunks(spark, d: str) -> DataFrame:
    """Chunks of at most six hours of each user's events, each event taken as a minute long."""
    ev = events(spark, d).withColumn("e", F.col("t") + 60)
    return timeline.greedy_chunks(ev, ["user_id"], "t", "e", 6 * 3600.0)


_D_SIM = f"{_D_E}, s AS (SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label, round(list_inner_product(e.v, q.v), 4) AS sim FROM e JOIN e q ON q.vec_id % 100 = 0)"


@query("vector_topk_filtered_batch", f"WITH {_D_SIM} SELECT query_id, vec_id, label, sim AS score FROM s WHERE vec_id <> query_id AND label = query_label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10")
def vector_topk_filtered_batch(spark, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.topk_batch(rows, rows.where("vec_id % 100 = 0"), 10, same_label=True).select("query_id", "vec_id", "label", "score")


@query("hybrid_window_search_batch", f"WITH {_D_SIM} SELECT query_id, label, vec_id, sim, round(0.6 * sim + 0.4 * avg(sim) OVER (PARTITION BY query_id, label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 3) AS score FROM s")
def hybrid_window_search_batch(spark, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    each = search.windowed_scores(rows, rows.where("vec_id % 100 = 0"), 3)
    return each.select("query_id", "label", "vec_id", "sim", F.round(0.6 * F.col("sim") + 0.4 * F.col("around"), 3).alias("score"))


@query("softmax_relevance_batch", f"WITH {_D_SIM}, x AS (SELECT query_id, label, vec_id, exp(sim / 0.5) AS x FROM s) SELECT query_id, label, vec_id, round(x / (sum(x) OVER (PARTITION BY query_id, label) + 1e-8), 5) AS p FROM x")
def softmax_relevance_batch(spark, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.softmax_scores(rows, rows.where("vec_id % 100 = 0"), 0.5).select("query_id", "label", "vec_id", F.round("p", 5).alias("p"))


@query("hierarchical_search_batch", f"WITH {_D_SIM}, g AS (SELECT query_id, label, round(avg(sim), 4) AS scene FROM s GROUP BY query_id, label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(avg(sim), 4) DESC, label) <= 3) SELECT query_id, label, vec_id, sim, scene, round(0.7 * sim + 0.3 * scene, 6) AS score FROM s JOIN g USING (query_id, label)")
def hierarchical_search_batch(spark, d: str) -> DataFrame:
    """Frames of each query's three best scenes: scenes are chosen by sums that blocks give, then only their frames are scored."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    means = search.scene_means(rows, asked).select("query_id", "label", F.round(F.round("total", 4) / F.col("n"), 4).alias("scene"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("scene"), "label"))
    best = means.withColumn("rank", rank).where("rank <= 3").drop("rank")
    wanted = best.select(F.col("query_id").alias("vec_id"), F.col("label")).join(asked.select("vec_id", "embedding"), "vec_id")
    sim = search.scores_batch(rows, wanted, same_label=True)
    return sim.join(best, ["query_id", "label"]).withColumn("score", F.round(0.7 * F.col("sim") + 0.3 * F.col("scene"), 6))


@query("lexical_bonus_rank_batch", "WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark WHERE item_id % 100 = 0), s AS (SELECT item_id, doc_id, source, coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), q)) / nullif(len(q), 0), 0) + CASE WHEN source = (SELECT min(source) FROM documents) THEN 0.05 ELSE 0 END AS x FROM documents, q) SELECT item_id, doc_id, source, round(x, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(x, 6) DESC, doc_id) <= 20")
def lexical_bonus_rank_batch(spark, d: str) -> DataFrame:
    """For every hundredth benchmark item the 20 documents that hold most of its words, with a bonus for the preferred source.

    Documents meet an item by the words that they share. Those that share none score by their source alone: of these the
    first 20 of either kind can be in an answer.
    """
    docs = table(spark, d, "documents")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
    asked = table(spark, d, "benchmark").where("item_id % 100 = 0").select("item_id", words("text").alias("q"))
    terms = asked.select("item_id", F.size("q").alias("n_words"), F.explode("q").alias("word"))
    preferred = docs.agg(F.min("source").alias("preferred"))
    own = docs.select("doc_id", F.explode(words("text")).alias("word"))
    shares = own.join(terms, "word").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n_words")).alias("share"))
    likes = docs.select("doc_id", "source").crossJoin(F.broadcast(preferred)).select("doc_id", "source", F.when(F.col("source") == F.col("preferred"), 0.05).otherwise(0.0).alias("bonus"))
    first = likes.where("bonus > 0").orderBy("doc_id").limit(20).union(likes.where("bonus = 0").orderBy("doc_id").limit(20))
    none = asked.select("item_id").crossJoin(F.broadcast(first.select("doc_id"))).withColumn("share", F.lit(0.0))
    each = shares.unionByName(none).groupBy("item_id", "doc_id").agg(F.max("share").alias("share")).join(likes, "doc_id")
    scored = each.select("item_id", "doc_id", "source", F.round(F.col("share") + F.col("bonus"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where("rank <= 20").drop("rank")


@query("graph_coappearance_batch", "WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS c FROM lineitem) SELECT a.c AS character, b.c AS other, count(*) AS n FROM e a JOIN e b ON a.s = b.s AND a.c <> b.c WHERE a.c % 100 = 0 GROUP BY ALL")
def graph_coappearance_batch(spark, d: str) -> DataFrame:
    e = graph_edges_distinct(spark, d)
    own = e.where("dst % 100 = 0").select("src", F.col("dst").alias("character"))
    return e.join(own, "src").where("dst <> character").groupBy("character", F.col("dst").alias("other")).agg(F.count("*").alias("n"))


@query("graph_timeline_batch", "SELECT DISTINCT l_partkey AS character, o_orderkey AS scene, strftime(o_orderdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 100 = 0")
def graph_timeline_batch(spark, d: str) -> DataFrame:
    e = graph_edges_distinct(spark, d).where("dst % 100 = 0")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return e.join(o, F.col("src") == F.col("o_orderkey")).select(F.col("dst").alias("character"), F.col("src").alias("scene"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
