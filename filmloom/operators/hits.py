"""Hits of several sources merged, rows replaced by key, quotas filled from what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_hits(hits: DataFrame, node: str, score: str, source: str, place: str) -> DataFrame:
    """node, score, place, source: each node's best hit, the first in place of equal ones; hits without a node go.

    The source is "hybrid" if a hit at a later place than the best comes from another source. A null score counts as 0,
    a null source is a source. Hits are first reduced to a row per node and source, of which a node has few.
    """
    rows = hits.where(F.col(node).isNotNull() & (F.col(node).cast("string") != ""))
    rows = rows.select(F.col(node).alias("_node"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s"), F.col(source).alias("_src"), F.col(place).alias("_p"))
    per = rows.groupBy("_node", "_src").agg(F.max("_s").alias("s"), F.max("_p").alias("last"), F.min_by("_p", F.struct(-F.col("_s"), F.col("_p"))).alias("p"))
    each = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("low"), F.col("p").alias("p"), F.col("_src").alias("src"), F.col("last").alias("last"))))
    best = per.groupBy("_node").agg(each.alias("all")).withColumn("best", F.col("all")[0])
    mixed = F.exists("all", lambda h: (h["last"] > F.col("best.p")) & ~h["src"].eqNullSafe(F.col("best.src")))
    return best.select(F.col("_node").alias(node), (-F.col("best.low")).alias(score), F.col("best.p").alias(place), F.when(mixed, F.lit("hybrid")).otherwise(F.col("best.src")).alias(source))


def best_hits_with(hits: DataFrame, node: str, score: str, source: str, place: str, *payload: str, names: str | None = None) -> DataFrame:
    """best_hits with the best hit's own columns `payload`. If its list `names` is empty, it is the first one with entries from where a later hit of another source makes the node hybrid."""
    best = best_hits(hits, node, score, source, place)
    own = hits.select(F.col(node).alias("_node"), F.col(place).alias("_p"), F.col(source).alias("_src"), *payload, *([F.col(names).alias("_own")] if names else []))
    out = best.join(own, (best[node] == F.col("_node")) & (best[place] == F.col("_p"))).drop("_node", "_p")
    if names is None:
        return out.drop("_src")
    after = hits.select(F.col(node).alias("_n"), F.col(place).alias("_at"), F.col(source).alias("_other"), F.col(names).alias("_names")).join(out.select(F.col(node).alias("_node"), F.col(place).alias("_best"), "_src"), F.col("_n") == F.col("_node")).where(F.col("_at") > F.col("_best"))
    turned = after.where(~F.col("_other").eqNullSafe(F.col("_src"))).groupBy(F.col("_n").alias("_t")).agg(F.min("_at").alias("_from"))
    given = after.join(turned, after["_n"] == turned["_t"]).where((F.col("_at") >= F.col("_from")) & (F.size("_names") > 0)).groupBy("_n").agg(F.min_by("_names", "_at").alias("_given"))
    both = out.join(given, out[node] == given["_n"], "left")
    return both.withColumn(names, F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.coalesce("_given", "_own"))).drop("_n", "_given", "_own", "_src")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing without the rows of any key that incoming has, and all of incoming; columns that one side lacks are null.

    A null key is a key. Repeated rows stay.
    """
    keys = incoming.select(F.col(key).alias("_key")).distinct()
    return existing.join(keys, existing[key].eqNullSafe(keys["_key"]), "left_anti").unionByName(incoming, allowMissingColumns=True)


def quota_with_leftovers(rows: DataFrame, key: str, keys: int, score: str, tie: str, most: int) -> DataFrame:
    """At most `most` rows: the best `most` div `keys` (one at least) of each key, then the best of the rest, with `rank` in the key.

    keys: how many were chosen. Of equal scores the smaller tie comes first. If the quotas alone exceed `most`, the first
    by key and tie stay.
    """
    quota = max(1, most // max(1, keys))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(score), tie))).where(F.col("_rank") <= max(most, 1))
    ranked = ranked.withColumn("rank", F.col("_rank").cast("long")).drop("_rank")  # no row beyond can be among the leftovers
    own = ranked.where(F.col("rank") <= quota)
    n = rows.groupBy(key).count().agg(F.sum(F.least("count", F.lit(quota)))).first()[0] or 0
    if n >= most:
        return own.orderBy(key, tie).limit(most)
    return own.unionByName(ranked.where(F.col("rank") > quota).orderBy(F.desc_nulls_last(score), key, tie).limit(most - n))
