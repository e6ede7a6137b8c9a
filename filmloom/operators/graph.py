"""Property-graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.scratch import written


def merge_nodes(parts: list[tuple[int, str, DataFrame]]) -> DataFrame:
    """One row per node id: the label of highest priority and how many sources name it. parts: (priority, label, ids)."""
    rows = None
    for priority, label, ids in parts:
        one = ids.select(F.col("id"), F.lit(priority).alias("p"), F.lit(label).alias("label"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.max_by("label", "p").alias("label"), F.count("*").alias("n_sources"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct edges and their reverses."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def shortest_paths(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """id, hops, path: nodes within `most` hops of start (column id) over directed edges (src, dst), with a shortest path from a start.

    Of several, the one whose last node before id is smallest, and so on back to the start. Edges and each hop's new nodes
    are written to the shared folder, so that no hop computes an earlier one again; a node is expanded once.
    """
    links = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    seen = written(start.where("id IS NOT NULL").select("id", F.lit(0).alias("hops"), F.array("id").alias("path")).distinct(), "seen")
    front = seen
    for i in range(1, most + 1):
        step = front.select(F.col("id").alias("src"), "path").join(links, "src")
        step = step.groupBy(F.col("dst").alias("id")).agg(F.min_by("path", "src").alias("path"))
        front = written(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(i).alias("hops"), F.concat("path", F.array("id")).alias("path")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def hops(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Nodes within `most` hops of start (column id) over directed edges (src, dst), with the least number of hops."""
    return shortest_paths(edges, start, most).select("id", "hops")


def _event_words(event: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(event), r"\s+"), lambda w: w != ""))


def similar_events(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: events of left (keys, a) and of right (keys, b) that are about the same: equal but for case and ends, or sharing two words, or one if either has a single one.

    Pairs come from an index of words within the keys.
    """
    word = lambda df, c: df.select(*keys, c).distinct().withColumn("_ws", _event_words(F.col(c))).select(*keys, c, F.size("_ws").alias(f"_n{c}"), F.explode("_ws").alias("_w"))
    both = word(left, "a").join(word(right, "b"), [*keys, "_w"]).groupBy(*keys, "a", "b", "_na", "_nb").agg(F.count("*").alias("_n"))
    return both.where(F.col("_n") >= F.least(F.lit(2), "_na", "_nb")).select(*keys, "a", "b")


def causal_chains(triples: DataFrame, targets: DataFrame, key: str, most: int = 4) -> DataFrame:
    """key, target, events, depth, n_triples, confidence: the chain of causes that leads to each target.

    triples: key, nth (their order in the key), cause, effect, confidence. targets: key, target. Triples with an effect
    similar to the target are direct ones, by confidence, then order; the five best stand in the chain, all give causes to
    explain. In each further round, up to `most` - 1, every cause in turn takes the first two triples that have a similar
    effect and a cause not met before, which is then met and stands in front of the chain. Targets without triples in
    their key have no row. Each round reads only the causes of the one before, written to the shared folder; a key's triples
    meet by the words that they share.
    """
    known = written(triples.where("cause IS NOT NULL AND effect IS NOT NULL").select(F.col(key).alias("k"), "nth", "cause", "effect", "confidence"), "triples")
    asked = targets.select(F.col(key).alias("k"), "target").distinct().join(known.select("k").distinct(), "k", "left_semi")
    like = written(similar_events(known.select("k", F.col("effect").alias("a")), asked.select("k", F.col("target").alias("b")).union(known.select("k", "cause")), ["k"]), "like")
    causes = lambda rows, to: rows.join(like.select("k", F.col("a").alias("effect"), F.col("b").alias(to)), ["k", to]).join(known, ["k", "effect"])
    direct = causes(asked, "target").groupBy("k", "target").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("low"), "nth", "cause"))).alias("d"))
    state = asked.join(direct, ["k", "target"], "left").withColumn("now", F.coalesce(F.transform("d", lambda x: x["cause"]), F.array().cast("array<string>")))
    top = F.slice("now", 1, 5)
    state = state.select("k", "target", F.concat(F.reverse(top), F.array("target")).alias("events"), F.size(top).alias("n"), "now", F.array_distinct("now").alias("met"), F.lit(1).alias("depth"))
    state = written(state, "chains")
    start = F.struct(F.array().cast("array<string>").alias("met"), F.array().cast("array<string>").alias("took"), F.lit(-1).alias("at"), F.lit(0).alias("n"))
    for _ in range(1, most):
        open_ = state.where(F.size("now") > 0)
        found = causes(open_.select("k", "target", "met", F.posexplode("now").alias("at", "b")).withColumnRenamed("b", "of"), "of").where(~F.array_contains("met", F.col("cause")))
        each = found.groupBy("k", "target").agg(F.array_sort(F.collect_list(F.struct("at", "nth", "cause"))).alias("all"))

        def take(acc: Column, x: Column) -> Column:
            # a cause's list is made before its first triple is taken: of its own, one cause may come twice
            n = F.when(acc["at"] == x["at"], acc["n"]).otherwise(0)
            before = F.when(acc["at"] == x["at"], acc["met"]).otherwise(acc["took"])
            use = (n < 2) & ~F.array_contains(before, x["cause"])
            return F.struct(before.alias("met"), F.when(use, F.concat(acc["took"], F.array(x["cause"]))).otherwise(acc["took"]).alias("took"), x["at"].alias("at"), F.when(use, n + 1).otherwise(n).alias("n"))

        new = each.select("k", "target", F.aggregate("all", start, take, lambda acc: acc["took"]).alias("new"))
        both = state.join(new, ["k", "target"], "left").withColumn("new", F.coalesce("new", F.array().cast("array<string>")))
        went = (F.size("now") > 0).cast("int")
        state = written(both.select("k", "target", F.concat(F.reverse("new"), "events").alias("events"), (F.col("n") + F.size("new")).alias("n"), F.col("new").alias("now"), F.array_distinct(F.concat("met", "new")).alias("met"), (F.col("depth") + went).alias("depth")), "chains", state)
        if state.where(F.size("now") > 0).isEmpty():
            break
    return state.select(F.col("k").alias(key), "target", F.array_distinct("events").alias("events"), "depth", F.col("n").alias("n_triples"), F.least(F.lit(1.0), F.col("n") * 0.2 + 0.2).alias("confidence"))
