"""Registered queries on the embeddings: clusters, assignments, choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.functions.vectors import dot, doubles
from filmloom.operators import choice, cluster, fusion, ranges, search, segments
from filmloom.plans.queries import _D_E
from filmloom.plans.registry import query
from filmloom.session import table

_D_U = f"{_D_E}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e)"


@query("dbscan_clusters", f"WITH RECURSIVE {_D_U}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label FROM u a JOIN u b ON a.label = b.label AND list_inner_product(a.v, b.v) >= 1 - 1.15 * 1.15 / 2), core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 3), ce AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), r(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id), num AS (SELECT vec_id AS root, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cluster FROM e WHERE vec_id IN (SELECT root FROM m)), k AS (SELECT id, cluster, true AS is_core FROM m JOIN num USING (root) UNION ALL SELECT p.a, min(cluster), false FROM p JOIN m ON m.id = p.b JOIN num USING (root) WHERE p.a NOT IN (SELECT id FROM core) GROUP BY p.a) SELECT vec_id, label, coalesce(cluster, -1)::INT AS cluster, coalesce(is_core, false) AS is_core FROM e LEFT JOIN k ON k.id = vec_id")
def dbscan_clusters(spark, d: str) -> DataFrame:
    """Clusters of each label's vectors; the tables' vectors lie far apart, so eps is wide."""
    return cluster.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 1.15, 3)


_D_PL = "pl AS (SELECT vec_id, label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM e)"


def in_order(spark, d: str) -> DataFrame:
    """The embeddings with their place in their label, by id."""
    return ranges.placed(table(spark, d, "embeddings"), "label", "vec_id")


@query("assign_parts", "WITH RECURSIVE s AS (SELECT l_returnflag AS g, l_suppkey AS i, l_partkey AS j, sum(l_quantity)::DOUBLE AS s FROM lineitem GROUP BY ALL), c AS (SELECT g, i, list({'j': j, 's': s} ORDER BY s DESC, j) AS js, row_number() OVER (PARTITION BY g ORDER BY i) AS k FROM s GROUP BY g, i), a(g, k, i, pick, used) AS (SELECT g, 0, NULL::BIGINT, NULL::STRUCT(j BIGINT, s DOUBLE), []::BIGINT[] FROM s GROUP BY g UNION ALL SELECT g, k, i, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.j) END FROM (SELECT c.g, c.k, c.i, a.used, list_filter(c.js, lambda x: NOT list_contains(a.used, x.j))[1] AS pick FROM a JOIN c ON c.g = a.g AND c.k = a.k + 1)) SELECT g AS l_returnflag, i AS l_suppkey, pick.j AS l_partkey, pick.s AS quantity FROM a WHERE pick IS NOT NULL")
def assign_parts(spark, d: str) -> DataFrame:
    """For each return flag, suppliers in order of key take the part they shipped most of that none before took."""
    shipped = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("quantity"))
    return choice.assign(shipped, "l_returnflag", "l_suppkey", "l_partkey", "quantity")


@query("coverage_selection")
def coverage_selection(spark, d: str) -> DataFrame:
    """Fifty vectors that stand for each label, relevant by their similarity to vector 0, placed in time by id."""
    rows = in_order(spark, d)
    q = rows.where("vec_id = 0").select(doubles(F.col("embedding")).alias("q")).limit(1)
    rows = rows.join(F.broadcast(q)).withColumn("relevance", F.round(dot(doubles(F.col("embedding")), F.col("q")), 4))
    return choice.cover(rows, "label", "place", "embedding", "relevance", "vec_id").select("label", "vec_id", "chosen")


@query("density_segments", f"WITH {_D_E}, {_D_PL}, s AS (SELECT label, place, round(list_inner_product(v, lead(v) OVER (PARTITION BY label ORDER BY place)), 6) AS sim FROM pl), g AS (SELECT label, place, (lead(sim, 5) OVER (PARTITION BY label ORDER BY place) - sim) / 5 AS change FROM s), low AS (SELECT label, quantile_cont(change, 0.15) AS low FROM g GROUP BY label), c AS (SELECT label, place, row_number() OVER (PARTITION BY label ORDER BY place) AS k FROM g JOIN low USING (label) WHERE change < low), n AS (SELECT label, count(*) AS n FROM e GROUP BY label), r AS (WITH RECURSIVE w(label, k, place, last, taken) AS (SELECT label, k, place, place, true FROM c WHERE k = 1 UNION ALL SELECT c.label, c.k, c.place, CASE WHEN c.place - w.last >= 3 THEN c.place ELSE w.last END, c.place - w.last >= 3 FROM w JOIN c ON c.label = w.label AND c.k = w.k + 1) SELECT label, place + 1 AS start FROM w WHERE taken UNION ALL SELECT label, 0 FROM n), b AS (SELECT r.label, start, coalesce(lead(start) OVER (PARTITION BY r.label ORDER BY start), n) AS stop, n FROM r JOIN n ON n.label = r.label), q AS (SELECT label, start, stop, n, CASE WHEN stop - start > 30 THEN (stop - start - 1) // 30 + 1 ELSE 1 END AS parts FROM b WHERE start = 0 OR stop - start >= 3), p AS (SELECT label, start + i * ((stop - start) // parts) AS start, CASE WHEN i < parts - 1 THEN start + (i + 1) * ((stop - start) // parts) ELSE stop END AS stop, n FROM (SELECT *, unnest(range(parts)) AS i FROM q)), f AS (SELECT label, start, CASE WHEN start = max(start) OVER (PARTITION BY label) THEN n ELSE stop END AS stop FROM p) SELECT f.label, start, stop::BIGINT AS \"end\", round(coalesce(avg(list_inner_product(x.v, y.v)), 1), 4) AS avg_similarity FROM f JOIN pl x ON x.label = f.label AND x.place >= start AND x.place < stop LEFT JOIN pl y ON y.label = x.label AND y.place > x.place AND y.place <= x.place + 4 AND y.place < stop GROUP BY f.label, start, stop")
def density_segments(spark, d: str) -> DataFrame:
    """Segments of each label's vectors, in order of id, cut where their neighbours' similarity falls most."""
    rows = in_order(spark, d)
    cuts = segments.density_boundaries(segments.neighbour_similarity(rows, "label", "place", "embedding"), "label", "place", "sim")
    return segments.segment_similarity(cuts, rows, "label", "place", "embedding").withColumn("avg_similarity", F.round("avg_similarity", 4))


@query("moving_average_merge", f"WITH {_D_E}, x AS (SELECT label, vec_id, unnest(range(64)) AS dim, unnest(v) AS c FROM e) SELECT label, vec_id, dim::INT AS dim, round(avg(c) OVER (PARTITION BY label, dim ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 5) AS mean FROM x")
def moving_average_merge(spark, d: str) -> DataFrame:
    """Each vector's mean with its neighbours in order of id, an entry a row."""
    merged = segments.nearby_mean(in_order(spark, d), "label", "place", "embedding")
    return merged.select("label", "vec_id", F.posexplode("merged").alias("dim", "mean")).withColumn("mean", F.round("mean", 5))


_D_HITS = (
    f"WITH {_D_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_inner_product(e.v, q.v), 4) AS score FROM e JOIN e q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), "
    "h AS (SELECT 'visual' AS source, query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s UNION ALL SELECT 'script', query_id, id, round(score * 0.9, 6), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 FROM s WHERE id % 2 = 0), "
    "f AS (SELECT *, (source = 'script')::INT * 100 + rank AS spot, CASE WHEN id % 3 > 0 THEN 'g' || id // 25 WHEN id % 5 > 0 THEN 'script_scene::' || id // 40 ELSE source || '::' || rank END AS scene FROM h WHERE rank < 12), "
    "c AS (SELECT query_id, scene, greatest(0, coalesce(max(score) FILTER (WHERE source = 'visual'), 0)) AS bv, greatest(0, coalesce(max(score) FILTER (WHERE source = 'script'), 0)) AS bs, count(*) FILTER (WHERE source = 'visual') AS nv, count(*) FILTER (WHERE source = 'script') AS ns, min(spot) AS lead_spot, min(id * 2)::DOUBLE AS start_s, max(id * 2 + 5)::DOUBLE AS end_s, arg_max('f' || id, {'s': score, 'r': rank}) FILTER (WHERE source = 'visual') AS frame FROM f GROUP BY ALL), "
    "r AS (SELECT *, 0.6 * bv + 0.4 * bs AS score, row_number() OVER (PARTITION BY query_id ORDER BY 0.6 * bv + 0.4 * bs DESC, bv DESC, bs DESC, nv DESC, ns DESC, lead_spot) - 1 AS place FROM c) "
)


@query("cluster_fusion", _D_HITS + "SELECT query_id, place::INT AS place, scene AS id, round(score, 6) AS score, start_s, end_s, frame, nv + ns AS evidence_count FROM r WHERE place < 6")
def cluster_fusion(spark, d: str) -> DataFrame:
    """For every hundredth vector, its twelve nearest of all and of even ids as two rankers' hits, fused by scene."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    ranked = lambda df, source, times: search.topk_batch(df, asked, fusion.HITS).select("query_id", F.lit(source).alias("source"), (F.col("rank") - 1).alias("rank"), F.round(F.col("score") * times, 6).alias("score"), "vec_id")
    hits = ranked(rows, "visual", 1.0).union(ranked(rows.where("vec_id % 2 = 0"), "script", 0.9))
    i, none = F.col("vec_id"), F.lit(None).cast("string")
    hits = hits.withColumns({
        "scene_group_id": F.when(i % 3 > 0, F.concat(F.lit("g"), F.floor(i / 25).cast("string"))), "scene_group_type": none, "script_scene_uid": F.when(i % 5 > 0, F.floor(i / 40).cast("string")), "start_s": (i * 2).cast("double"), "end_s": (i * 2 + 5).cast("double"),
        "path": F.concat(F.lit("f"), i.cast("string")), "scene_score": F.lit(0.0), "characters": F.array().cast("array<string>"), "script_characters": F.array().cast("array<string>"), **{c: none for c in ("parent_scene_id", "subscene_id", "chunk_id", "clip_id", "movie_id", "heading", "location", "cue")},
    })
    return fusion.fuse(hits, "query_id").select("query_id", "place", "id", F.round("score", 6).alias("score"), "start_s", "end_s", "frame", "evidence_count")
