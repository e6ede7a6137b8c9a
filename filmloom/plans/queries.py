"""Registered queries: each an operator applied to whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions import text as T
from filmloom.functions.vectors import dot, doubles, mean_vector
from filmloom.operators import graph, ranges, search, timeline
from filmloom.plans.registry import query
from filmloom.session import table

_SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 1000000D"
_D_EV = "ev AS (SELECT event_id, user_id, event_type, value, props, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000.0::DOUBLE AS t FROM events)"
_D_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def events(spark, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", F.expr(_SECONDS).alias("t"))


def scenes(spark, d: str) -> DataFrame:
    """A scene per user and day: its first and last event."""
    return events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.min("t").alias("s0"), F.max("t").alias("s1"))


_D_SC = "sc AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, min(t) AS s0, max(t) AS s1 FROM ev GROUP BY ALL)"


@query("vector_topk_filtered", f"WITH {_D_E}, q AS (SELECT vec_id AS q_id, v AS q, label AS l FROM e WHERE vec_id = 0) SELECT vec_id, label, round(list_inner_product(v, q), 4) AS score FROM e, q WHERE vec_id <> q_id AND label = l ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = rows.where("vec_id = 0").select(F.col("vec_id").alias("q_id"), doubles(F.col("embedding")).alias("q"), F.col("label").alias("l"))
    return search.topk_one(rows.join(F.broadcast(q.select("l").limit(1)), F.col("label") == F.col("l"), "left_semi"), q.drop("l"), 10)


_D_TOP = f"{_D_E}, s AS (SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label, round(list_inner_product(e.v, q.v), 4) AS score FROM e JOIN e q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


def _top(spark, d: str, k: int) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.topk_batch(rows, rows.where("vec_id % 100 = 0"), k)


def _top_labelled(spark, d: str, k: int) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return _top(spark, d, k).join(rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query("vector_topk_batch", f"WITH {_D_TOP} SELECT query_id, vec_id, label, score, rank FROM r WHERE rank <= 10")
def vector_topk_batch(spark, d: str) -> DataFrame:
    return _top(spark, d, 10)


@query("recall_mrr_at_k", f"WITH {_D_TOP}, f AS (SELECT query_id, min(CASE WHEN label = query_label THEN rank END) AS first FROM r WHERE rank <= 10 GROUP BY query_id) SELECT count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f")
def recall_mrr_at_k(spark, d: str) -> DataFrame:
    first = _top_labelled(spark, d, 10).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("query_label"), F.col("rank"))).alias("first"))
    at = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}")
    return first.agg(F.count("*").alias("n"), at(1), at(5), at(10), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("cross_group_confusion", f"WITH {_D_TOP}, f AS (SELECT query_label, arg_min(label, rank) AS other FROM r WHERE rank <= 20 AND label <> query_label GROUP BY query_id, query_label) SELECT query_label, other, count(*) AS n FROM f GROUP BY ALL")
def cross_group_confusion(spark, d: str) -> DataFrame:
    foreign = _top_labelled(spark, d, 20).where("label <> query_label")
    first = foreign.groupBy("query_id", "query_label").agg(F.min_by("label", "rank").alias("other"))
    return first.groupBy("query_label", "other").agg(F.count("*").alias("n"))


@query("identify_group_vote", f"WITH {_D_TOP}, c AS (SELECT query_id, label, count(*) AS votes, min(rank) AS first FROM r WHERE rank <= 10 GROUP BY ALL) SELECT query_id, label, votes FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) = 1")
def identify_group_vote(spark, d: str) -> DataFrame:
    votes = _top(spark, d, 10).groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    best = votes.groupBy("query_id").agg(F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("first"))).alias("b"))
    return best.select("query_id", "b.label", "b.votes")


@query("vector_mean_pool_group", f"WITH {_D_E}, x AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL) SELECT label, (i - 1)::INT AS place, round(m, 5) AS mean FROM m")
def vector_mean_pool_group(spark, d: str) -> DataFrame:
    pooled = mean_vector(table(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("place", "mean")).withColumn("mean", F.round("mean", 5))


@query("sim_drop_segments", f"WITH {_D_E}, s AS (SELECT label, vec_id, round(list_inner_product(v, lag(v) OVER w), 4) AS sim FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, vec_id, sim, sum(CASE WHEN sim < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS segment FROM s")
def sim_drop_segments(spark, d: str) -> DataFrame:
    v = doubles(F.col("embedding"))
    rows = ranges.placed(table(spark, d, "embeddings").select("label", "vec_id", v.alias("v")), "label", "vec_id")
    out = ranges.over_ranges(rows, "label", "place", 1, 0, lambda w: {"sim": F.round(dot(F.col("v"), F.lag("v").over(w)), 4)}).drop("v")
    drops = F.when(F.col("sim") < 0.3, 1).otherwise(0)
    return ranges.running_sum(out, "label", "place", drops, "segment").drop("place")


@query("hybrid_window_search", f"WITH {_D_E}, q AS (SELECT v AS q FROM e WHERE vec_id = 0), s AS (SELECT label, vec_id, round(list_inner_product(v, q), 4) AS sim FROM e, q) SELECT label, vec_id, sim, round(0.6 * sim + 0.4 * avg(sim) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 3) AS score FROM s")
def hybrid_window_search(spark, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = rows.where("vec_id = 0").select(doubles(F.col("embedding")).alias("q")).limit(1)
    sim = rows.join(F.broadcast(q)).select("label", "vec_id", F.round(dot(doubles(F.col("embedding")), F.col("q")), 4).alias("sim"))
    score = lambda w: {"score": F.round(0.6 * F.col("sim") + 0.4 * F.avg("sim").over(w.rowsBetween(-3, 3)), 3)}
    return ranges.over_ranges(ranges.placed(sim, "label", "vec_id"), "label", "place", 3, 3, score).drop("place")


@query("softmax_relevance", f"WITH {_D_E}, q AS (SELECT v AS q FROM e WHERE vec_id = 0), s AS (SELECT label, vec_id, exp(round(list_inner_product(v, q), 4) / 0.5) AS x FROM e, q) SELECT label, vec_id, round(x / (sum(x) OVER (PARTITION BY label) + 1e-8), 5) AS p FROM s")
def softmax_relevance(spark, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = rows.where("vec_id = 0").select(doubles(F.col("embedding")).alias("q")).limit(1)
    x = rows.join(F.broadcast(q)).select("label", "vec_id", F.exp(F.round(dot(doubles(F.col("embedding")), F.col("q")), 4) / 0.5).alias("x"))
    total = x.groupBy("label").agg(F.sum("x").alias("total"))
    both = x.join(total.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
    return both.select("label", "vec_id", F.round(F.col("x") / (F.col("total") + 1e-8), 5).alias("p"))


@query("interval_join_cues", f"WITH {_D_EV}, {_D_SC}, c AS (SELECT event_id, user_id, t AS c0, t + 30 AS c1 FROM ev) SELECT c.event_id, sc.user_id, sc.day FROM c JOIN sc ON c.user_id = sc.user_id AND c.c1 >= sc.s0 AND c.c0 <= sc.s1")
def interval_join_cues(spark, d: str) -> DataFrame:
    cues = events(spark, d).select("event_id", "user_id", F.col("t").alias("c0"), (F.col("t") + 30).alias("c1"))
    return timeline.interval_join(cues, scenes(spark, d), "user_id", ("c0", "s0"), ("c1", "s1"), 86400.0).select("event_id", "user_id", "day")


@query("dominant_overlap", f"WITH {_D_EV}, {_D_SC}, c AS (SELECT event_id, user_id, t - 40000 AS c0, t + 40000 AS c1 FROM ev), o AS (SELECT event_id, day, s0, greatest(0, least(c1, s1) - greatest(c0, s0)) AS ov FROM c JOIN sc ON c.user_id = sc.user_id AND c1 >= s0 AND c0 <= s1) SELECT event_id, day, round(ov, 3) AS overlap_s FROM o QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ov DESC, s0) = 1")
def dominant_overlap(spark, d: str) -> DataFrame:
    cues = events(spark, d).select("event_id", "user_id", (F.col("t") - 40000).alias("c0"), (F.col("t") + 40000).alias("c1"))
    both = timeline.interval_join(cues, scenes(spark, d), "user_id", ("c0", "s0"), ("c1", "s1"), 86400.0)
    ov = timeline.overlap(F.col("c0"), F.col("c1"), F.col("s0"), F.col("s1"))
    best = both.withColumn("ov", ov).groupBy("event_id").agg(F.max_by(F.struct("day", "ov"), F.struct(F.col("ov"), -F.col("s0"))).alias("b"))
    return best.select("event_id", "b.day", F.round("b.ov", 3).alias("overlap_s"))


@query("nearest_join", f"WITH {_D_EV}, a AS (SELECT * FROM ev WHERE event_type = 'error'), b AS (SELECT event_id AS bid, user_id, t AS bt FROM ev WHERE event_type = 'purchase'), j AS (SELECT a.event_id, a.user_id, bid, abs(bt - a.t) AS dist, bt FROM a LEFT JOIN b ON a.user_id = b.user_id AND abs(bt - a.t) <= 86400) SELECT event_id, user_id, bid AS near_event_id, round(dist, 3) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dist, bt, bid) = 1")
def nearest_join(spark, d: str) -> DataFrame:
    ev = events(spark, d)
    left = ev.where("event_type = 'error'").select(F.col("event_id").alias("a_id"), "user_id", F.col("t").alias("a_t"))
    out = timeline.nearest_join(left, ev.where("event_type = 'purchase'").select("user_id", "event_id", "t"), "user_id", "a_t", "t", "event_id", 86400.0)
    return out.select(F.col("a_id").alias("event_id"), "user_id", "near_event_id", F.round("distance", 3).alias("distance"))


@query("presence_segments", f"WITH {_D_EV}, n AS (SELECT *, CASE WHEN t - lag(t) OVER w > 21600 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING)::BIGINT AS segment FROM n) SELECT user_id, segment, round(min(t), 3) AS start_s, round(max(t), 3) AS end_s, count(*) AS n FROM s GROUP BY ALL")
def presence_segments(spark, d: str) -> DataFrame:
    return timeline.presence(events(spark, d), ["user_id"], "t", 21600.0).withColumns({c: F.round(c, 3) for c in ("start_s", "end_s")})


@query("interval_iou", f"WITH {_D_EV}, {_D_SC}, p AS (SELECT *, lead(s0) OVER w AS n0, lead(s1) OVER w AS n1 FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, round(greatest(0, least(s1 + 50000, n1) - greatest(s0, n0)) / (greatest(s1 + 50000, n1) - least(s0, n0)), 5) AS iou FROM p WHERE n0 IS NOT NULL")
def interval_iou(spark, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("day")
    p = scenes(spark, d).withColumn("n0", F.lead("s0").over(w)).withColumn("n1", F.lead("s1").over(w)).where("n0 IS NOT NULL")
    return p.select("user_id", "day", F.round(timeline.hull_iou(F.col("s0"), F.col("s1") + 50000, F.col("n0"), F.col("n1")), 5).alias("iou"))


@query("narrative_arc_time", f"WITH {_D_EV}, r AS (SELECT event_id, t / max(t) OVER (PARTITION BY user_id) AS x FROM ev) SELECT event_id, CASE WHEN x < 0.15 THEN 'exposition' WHEN x < 0.4 THEN 'rising_action' WHEN x < 0.65 THEN 'climax' WHEN x < 0.85 THEN 'falling_action' ELSE 'resolution' END AS arc FROM r")
def narrative_arc_time(spark, d: str) -> DataFrame:
    x = F.col("t") / F.max("t").over(Window.partitionBy("user_id"))
    return events(spark, d).select("event_id", timeline.arc_by_ratio(x).alias("arc"))


@query("narrative_arc_rows", "WITH r AS (SELECT conv_id, turn, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY conv_id) AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CASE WHEN x < 0.1 THEN 'exposition' WHEN x < 0.5 THEN 'rising_action' WHEN x < 0.6 THEN 'climax' WHEN x < 0.8 THEN 'falling_action' ELSE 'resolution' END AS arc FROM r")
def narrative_arc_rows(spark, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    x = (F.row_number().over(w.orderBy("turn")) - 1) / F.count("*").over(w)
    arc = F.when(x < 0.1, "exposition").when(x < 0.5, "rising_action").when(x < 0.6, "climax").when(x < 0.8, "falling_action").otherwise("resolution")
    return table(spark, d, "conversations").select("conv_id", "turn", arc.alias("arc"))


@query("followed_by_edges", "SELECT conv_id, turn AS src, lead(turn) OVER w AS dst, lead(role) OVER w AS dst_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY dst IS NOT NULL")
def followed_by_edges(spark, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("src"), F.lead("turn").over(w).alias("dst"), F.lead("role").over(w).alias("dst_role"))
    return out.where("dst IS NOT NULL")


@query("scene_aggregate", "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, count(DISTINCT role) AS n_roles FROM conversations GROUP BY conv_id")
def scene_aggregate(spark, d: str) -> DataFrame:
    roles = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"), roles.alias("roles"), F.countDistinct("role").alias("n_roles"))


@query("layer_quality_score", "SELECT d.doc_id, round(0.2 * (text <> '')::INT + 0.25 * (lang IS NOT NULL)::INT + 0.2 * (quality IS NOT NULL)::INT + 0.2 * (coalesce(quality, 0) = 1)::INT + 0.15 * (coalesce(toxic, 1) = 0)::INT, 4)::DOUBLE AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def layer_quality_score(spark, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "text", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = 0.2 * one(F.col("text") != "") + 0.25 * one(F.col("lang").isNotNull()) + 0.2 * one(F.col("quality").isNotNull()) + 0.2 * one(F.col("quality") == 1) + 0.15 * one(F.col("toxic") == 0)
    return both.select("doc_id", F.round(score, 4).alias("score"))


@query("layer_coverage", "SELECT source, count(*) AS n, round(avg((l.doc_id IS NOT NULL)::INT), 6) AS labelled, round(avg((coalesce(quality, 0) = 1)::INT), 6) AS good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def layer_coverage(spark, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumn("has", F.lit(1))
    both = table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    share = lambda c, name: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(name)
    return both.groupBy("source").agg(F.count("*").alias("n"), share(F.col("has").isNotNull(), "labelled"), share(F.col("quality") == 1, "good"))


@query("quality_table_select", "SELECT source, count(*) AS n, round(avg(coalesce(quality, 0)), 4) AS avg_quality, round(avg(coalesce(quality, 0)) * log2(count(*) + 1), 4) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def quality_table_select(spark, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    q, n = F.avg(F.coalesce("quality", F.lit(0))), F.count("*")
    return both.groupBy("source").agg(n.alias("n"), F.round(q, 4).alias("avg_quality"), F.round(q * F.log2(n + 1), 4).alias("score"))


@query("quota_selection", "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT doc_id, source, k FROM r WHERE k <= 5")
def quota_selection(spark, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").withColumn("k", k).where("k <= 5").select("doc_id", "source", "k")


@query("compose_text", "SELECT doc_id, concat_ws(' | ', CASE WHEN lang <> '' THEN 'lang: ' || lang END, CASE WHEN source <> 'src0' THEN 'source: ' || source END, nullif(text, '')) AS composed FROM documents")
def compose_text(spark, d: str) -> DataFrame:
    part = F.concat_ws(" | ", F.when(F.col("lang") != "", F.concat(F.lit("lang: "), "lang")), F.when(F.col("source") != "src0", F.concat(F.lit("source: "), "source")), F.nullif("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", part.alias("composed"))


_D_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_D_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("normalise_tokens", f"SELECT doc_id, array_to_string(list_filter(string_split({_D_NORM}, ' '), lambda w: length(w) >= 2 AND w NOT IN ({_D_STOP})), ' ') AS toks FROM documents")
def normalise_tokens(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", T.tokens(F.col("text"))).alias("toks"))


@query("keyword_classify", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'fight|argue|attack') THEN 'conflict' WHEN regexp_matches(lower(text), 'drive|walk|road') THEN 'travel' WHEN regexp_matches(lower(text), 'kiss|love') THEN 'romance' ELSE 'general' END AS situation FROM documents")
def keyword_classify(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.situation(F.col("text")).alias("situation"))


@query("dialogue_quality", rf"WITH w AS (SELECT conv_id, turn, text, list_filter(string_split({_D_NORM}, ' '), lambda x: x <> '') AS ws FROM conversations) SELECT conv_id, turn, round(least(1.0, greatest(0.0, 0.5 * (len(ws) > 0)::INT + 0.2 * coalesce(len(list_distinct(ws)) / nullif(len(ws), 0), 0) + 0.2 * coalesce(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / nullif(length(text), 0), 0) + CASE WHEN len(ws) >= 3 THEN 0.1 ELSE 0 END)), 4) AS quality FROM w")
def dialogue_quality(spark, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(T.dialogue_quality(F.col("text")), 4).alias("quality"))


_D_ANY = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_D_LABEL = lambda default, labels: "CASE " + " ".join(f"WHEN {_D_ANY(w)} THEN '{n}'" for n, w in labels) + f" ELSE '{default}' END"
_D_LABELS = lambda default, labels: "(SELECT CASE WHEN len(x) > 0 THEN x ELSE ['" + default + "'] END FROM (SELECT list_filter([" + ", ".join(f"CASE WHEN {_D_ANY(w)} THEN '{n}' END" for n, w in labels) + "], lambda y: y IS NOT NULL) AS x))"


_D_KEYWORDS = "WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) SELECT doc_id, " + ", ".join(f"{_D_LABEL(*T.ACTIVITY[k])} AS {k}" for k in T.ACTIVITY) + f", array_to_string({_D_LABELS(*T.SEVERAL['actions'])}, ' ') AS actions, CASE WHEN low = '' THEN '' ELSE array_to_string({_D_LABELS(*T.SEVERAL['audio'])}, ' ') END AS audio FROM d"


@query("keyword_labels")
def keyword_labels(spark, d: str) -> DataFrame:
    """The reference's labels of each document; keyword_classify knows three classes of its own."""
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return docs.select("doc_id", *[T.label_of(F.col("low"), k).alias(k) for k in T.ACTIVITY], *[T.labels_of(F.col("low"), k).alias(k) for k in T.SEVERAL])


@query("keyword_label_texts", _D_KEYWORDS)
def keyword_label_texts(spark, d: str) -> DataFrame:
    """keyword_labels with each list of labels as one text."""
    return keyword_labels(spark, d).withColumns({k: F.array_join(k, " ") for k in T.SEVERAL})


@query("imported_labels", f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, string_split(lower(coalesce(lang, '') || ' ' || left(coalesce(text, ''), 200)), ' ') AS own FROM documents) SELECT doc_id, {_D_LABEL('outdoor', T.IMPORTED['setting'])} AS setting, array_to_string({_D_LABELS('interacting', T.IMPORTED['actions'])}, ' ') AS actions, CASE " + " ".join(f"WHEN {_D_ANY(T.TENSE) if w is None else f'list_has_any(own, {list(w)})'} THEN '{n}'" for n, w in T.MOODS) + " ELSE 'neutral' END AS emotion FROM d")
def imported_labels(spark, d: str) -> DataFrame:
    """Setting, actions and mood of each document as an imported chunk; its language and first words are its attributes."""
    text = F.coalesce("text", F.lit(""))
    own = F.split(F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.substring(text, 1, 200)), " ")
    docs = table(spark, d, "documents").select("doc_id", F.lower(text).alias("low"), own.alias("own"))
    return docs.select("doc_id", T.imported_setting(F.col("low")).alias("setting"), F.array_join(T.imported_actions(F.col("low")), " ").alias("actions"), T.imported_emotion(F.col("own"), F.col("low")).alias("emotion"))


@query("dialogue_scores", r"WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ') AS t FROM conversations), w AS (SELECT conv_id, turn, t, lower(t) AS low, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS ws FROM c) SELECT conv_id, turn, round(CASE WHEN len(ws) = 0 THEN 0 ELSE least(1.0, greatest(0.0, 0.5 + least(0.25, 0.35 * (len(list_distinct(ws))::DOUBLE / len(ws))) + least(0.2, 0.2 * (length(regexp_replace(t, '[^\p{L}]', '', 'g'))::DOUBLE / length(t))) + CASE WHEN len(ws) >= 12 THEN 0.1 ELSE 0 END - CASE WHEN len(regexp_extract_all(low, 'thank you')) >= 3 THEN 0.25 ELSE 0 END - 0.2 * (" + " + ".join(f"contains(low, '{w}')::INT" for w in T.NOISE) + "))) END, 4)::DOUBLE AS quality FROM w")
def dialogue_scores(spark, d: str) -> DataFrame:
    """The reference's score of each turn, with marks of noise; dialogue_quality has none."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(T.dialogue_score(F.col("text")), 4).alias("quality"))


@query("causal_triples", r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+\s+(?:the|of)\s+\p{L}+')) AS triple FROM documents) SELECT triple, count(*) AS n, min(doc_id) AS first_doc FROM m GROUP BY triple")
def causal_triples(spark, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+\s+(?:the|of)\s+\p{L}+"), F.lit(0))).alias("triple"))
    return hits.groupBy("triple").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("causal_statements")
def causal_statements(spark, d: str) -> DataFrame:
    """Cause and effect of each causal statement of a document; causal_triples only counts words around 'the' and 'of'."""
    hits = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("evidence"), F.explode(T.causal_triples(F.col("text"))).alias("t"))
    return hits.select("doc_id", "t.cause", F.lit("causes").alias("relation"), "t.effect", "evidence", F.lit(0.7).alias("confidence"))


@query("causal_chains")
def causal_chains(spark, d: str) -> DataFrame:
    """The chain of causes of every effect that a document states. The test tables state none."""
    hits = table(spark, d, "documents").select("doc_id", F.posexplode(T.causal_triples(F.col("text"))).alias("nth", "t"))
    triples = hits.select("doc_id", "nth", "t.cause", "t.effect", F.lit(0.7).alias("confidence"))
    return graph.causal_chains(triples, triples.select("doc_id", F.col("effect").alias("target")), "doc_id")


@query("tag_strip_blocks", r"SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages")
def tag_strip_blocks(spark, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.without_markup(F.col("html")).alias("plain"))


@query("dedup_anti_union", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id, 'unlabelled' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def dedup_anti_union(spark, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("source", F.lit("unlabelled")))


@query("graph_edges_distinct", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def graph_edges_distinct(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("graph_nodes_merge", "WITH n AS (SELECT p_partkey AS id, 1 AS p, 'Character' AS label FROM part UNION ALL SELECT s_suppkey, 2, 'Location' FROM supplier UNION ALL SELECT n_nationkey, 3, 'Movie' FROM nation) SELECT id, arg_max(label, p) AS label, count(*) AS n_sources FROM n GROUP BY id")
def graph_nodes_merge(spark, d: str) -> DataFrame:
    ids = lambda t, c: table(spark, d, t).select(F.col(c).cast("long").alias("id"))
    return graph.merge_nodes([(1, "Character", ids("part", "p_partkey")), (2, "Location", ids("supplier", "s_suppkey")), (3, "Movie", ids("nation", "n_nationkey"))])


@query("graph_most_connected", "SELECT l_orderkey AS scene, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY scene ORDER BY n DESC, scene LIMIT 20")
def graph_most_connected(spark, d: str) -> DataFrame:
    return graph_edges_distinct(spark, d).groupBy(F.col("src").alias("scene")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scene").limit(20)


@query("graph_coappearance", "WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS c FROM lineitem) SELECT b.c AS other, count(*) AS n FROM e a JOIN e b ON a.s = b.s AND a.c <> b.c WHERE a.c = 7 GROUP BY other")
def graph_coappearance(spark, d: str) -> DataFrame:
    e = graph_edges_distinct(spark, d)
    own = e.where("dst = 7").select("src")
    return e.join(own, "src", "left_semi").where("dst <> 7").groupBy(F.col("dst").alias("other")).agg(F.count("*").alias("n"))


@query("graph_timeline", "SELECT DISTINCT l_partkey AS character, o_orderkey AS scene, strftime(o_orderdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = 7")
def graph_timeline(spark, d: str) -> DataFrame:
    e = graph_edges_distinct(spark, d).where("dst = 7")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return e.join(o, F.col("src") == F.col("o_orderkey")).select(F.col("dst").alias("character"), F.col("src").alias("scene"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("graph_window_neighbours", "SELECT a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 30")
def graph_window_neighbours(spark, d: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("t"))
    a = o.select("o_custkey", F.col("o_orderkey").alias("src"), (F.col("t") - 30).alias("a0"), (F.col("t") + 30).alias("a1"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("dst"), F.col("t").alias("b0"), F.col("t").alias("b1"))
    return timeline.interval_join(a, b, "o_custkey", ("a0", "b0"), ("a1", "b1"), 60.0).where("src <> dst").select("src", "dst")


@query("graph_multi_group_entities", "SELECT p_name, count(DISTINCT p_brand) AS n_groups FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2")
def graph_multi_group_entities(spark, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_name").agg(F.countDistinct("p_brand").alias("n_groups")).where("n_groups >= 2")


@query("graph_bfs4", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, (l_partkey % 1000) AS dst FROM lineitem), r(id, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM r JOIN e ON e.src = r.id WHERE hops < 4) SELECT id, min(hops)::INT AS hops FROM r GROUP BY id")
def graph_bfs4(spark, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 1000).alias("dst")).distinct()
    return graph.hops(e, spark.range(1, 2).select("id"), 4)


_D_BFS = "e AS (SELECT DISTINCT 's:' || l_suppkey AS a, 'p:' || l_partkey AS b FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL), g AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e), r(id, hops) AS (SELECT 's:' || s_suppkey, 0 FROM supplier WHERE s_suppkey = 1 UNION SELECT dst, hops + 1 FROM r JOIN g ON src = id WHERE hops < 4), h AS (SELECT id, min(hops)::INT AS hops FROM r GROUP BY id)"


@query("graph_shortest_paths", f"WITH RECURSIVE {_D_BFS}, up AS (SELECT n.id, n.hops, min(m.id) AS parent FROM h n JOIN g ON dst = n.id JOIN h m ON m.id = src AND m.hops = n.hops - 1 GROUP BY n.id, n.hops), p(id, hops, path) AS (SELECT id, hops, id FROM h WHERE hops = 0 UNION ALL SELECT up.id, up.hops, path || ' ' || up.id FROM p JOIN up ON up.parent = p.id) SELECT id, hops, path FROM p")
def graph_shortest_paths(spark, d: str) -> DataFrame:
    """A shortest path from supplier 1 to each part and supplier within 4 hops, links followed both ways."""
    return graph.shortest_paths(*_parts_and_suppliers(spark, d), 4).withColumn("path", F.array_join("path", " "))


@query("graph_paths4", f"WITH RECURSIVE {_D_BFS} SELECT id, hops FROM h")
def graph_paths4(spark, d: str) -> DataFrame:
    """Parts and suppliers within 4 hops of supplier 1, links followed both ways."""
    return graph.hops(*_parts_and_suppliers(spark, d), 4)


def _parts_and_suppliers(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Links both ways between parts and suppliers, and supplier 1; ids keep their kind: p:1 is not s:1."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    e = table(spark, d, "lineitem").select(node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    start = table(spark, d, "supplier").where("s_suppkey = 1").select(node("s", "s_suppkey").alias("id"))
    return graph.both_ways(e), start


@query("identity_map", "SELECT lower(n_name) AS name, count(*) AS n, min(s_suppkey) AS first_supplier, count(DISTINCT s_acctbal > 0) AS n_signs FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY lower(n_name)")
def identity_map(spark, d: str) -> DataFrame:
    both = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return both.groupBy(F.lower("n_name").alias("name")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first_supplier"), F.countDistinct(F.col("s_acctbal") > 0).alias("n_signs"))


@query("canonical_pick", "SELECT l_partkey AS part, l_orderkey AS scene, l_linenumber AS line, count(*) OVER (PARTITION BY l_partkey) AS split_count FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) = 1")
def canonical_pick(spark, d: str) -> DataFrame:
    key = F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber", "l_suppkey")
    best = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(key).alias("b"), F.count("*").alias("split_count"))
    return best.select(F.col("l_partkey").alias("part"), F.col("b.l_orderkey").alias("scene"), F.col("b.l_linenumber").alias("line"), "split_count")


@query("stage_pass_rate", "SELECT lang, count(*) AS n, round(avg((quality = 1)::INT), 6) AS quality_rate, round(avg((toxic = 0)::INT), 6) AS clean_rate, round(avg((quality = 1 AND toxic = 0)::INT), 6) AS pass_rate FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def stage_pass_rate(spark, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    return both.groupBy("lang").agg(F.count("*").alias("n"), rate(good, "quality_rate"), rate(clean, "clean_rate"), rate(good & clean, "pass_rate"))


@query("json_props", "SELECT event_type, (json_extract_string(props, '$.k'))::INT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
