"""Segments of a key's ordered vectors: neighbours' similarity, its falls, and means of vectors nearby."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions.vectors import dot, doubles
from filmloom.operators import timeline
from filmloom.operators.ranges import over_ranges, percentile, running_sum


def neighbour_similarity(rows: DataFrame, key: str, place: str, vec: str, digits: int = 6) -> DataFrame:
    """key, place, sim: the inner product of each row's vector with the next one's of its key, null at the last."""
    v = doubles(F.col(vec))
    return over_ranges(rows.select(key, place, v.alias("_v")), key, place, 0, 1, lambda w: {"sim": F.round(dot(F.col("_v"), F.lead("_v").over(w)), digits)}).drop("_v")


def density_boundaries(sims: DataFrame, key: str, place: str, sim: str, window: int = 5, share: float = 0.15, least: int = 3, longest: int = 30) -> DataFrame:
    """key, start, end: segments of each key's rows, cut where the mean similarity of `window` neighbours falls most.

    sims: a row per place of a key, from 0, with its similarity to the next row, null at the last. The mean over the
    `window` similarities from place p on changes at p by (sim[p + window] - sim[p]) / window. A place whose change lies below
    the key's value at `share` of their order is a candidate; in order, those that lie `least` places or more after the
    last one taken end a segment. Keys with fewer than `window` similarities are one segment. Segments longer than
    `longest` are cut into as few parts of equal length as do, the last of which takes the rest. A last segment of fewer
    than `least` rows joins the one before it, however long.
    """
    moved = over_ranges(sims.select(key, place, sim), key, place, 0, window, lambda w: {"_change": (F.lead(sim, window).over(w) - F.col(sim)) / window})
    low = percentile(moved, key, "_change", share, "_low").withColumnRenamed(key, "_key")
    found = moved.join(low, moved[key].eqNullSafe(low["_key"])).where(F.col("_change") < F.col("_low")).select(key, F.col(place).alias("_p"))
    taken = timeline.greedy_chunks(found, [key], "_p", "_p", least - 1.0).select(F.col(key), (F.col("start_s") + 1).cast("long").alias("start"))
    n = sims.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    cuts = taken.join(n, taken[key].eqNullSafe(n["_key"])).where(F.col("_n") - F.col("start") >= least).drop("_key")
    cuts = cuts.unionByName(n.select(F.col("_key").alias(key), F.lit(0).cast("long").alias("start"), "_n"))
    tail = taken.join(n, taken[key].eqNullSafe(n["_key"])).where(F.col("_n") - F.col("start") < least).select(F.col("_key").alias("_k"), F.col("start").alias("_tail"))
    own = Window.partitionBy(key).orderBy("start")
    cuts = cuts.join(tail, cuts[key].eqNullSafe(tail["_k"]), "left").withColumn("_next", F.lead("start").over(own))
    size = F.coalesce("_next", "_tail", "_n") - F.col("start")
    parts = F.when(size > longest, F.floor((size - 1) / longest) + 1).otherwise(1)
    each = cuts.select(key, "start", "_next", "_n", size.alias("_size"), parts.alias("_parts")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    step = F.floor(F.col("_size") / F.col("_parts"))
    last = F.coalesce("_next", "_n")
    return each.select(key, (F.col("start") + F.col("_i") * step).alias("start"), F.when(F.col("_i") < F.col("_parts") - 1, F.col("start") + (F.col("_i") + 1) * step).otherwise(last).alias("end"))


def segment_similarity(segments: DataFrame, rows: DataFrame, key: str, place: str, vec: str, reach: int = 4) -> DataFrame:
    """segments (key, start, end) with avg_similarity: the mean inner product of their rows at most `reach` places apart, 1 for a single row."""
    v = doubles(F.col(vec))
    ahead = over_ranges(rows.select(key, place, v.alias("_v")), key, place, 0, reach, lambda w: {"_sims": F.array(*[dot(F.col("_v"), F.lead("_v", k).over(w)) for k in range(1, reach + 1)])})
    each = segments.select(F.col(key).alias("_key"), "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("_p"))
    both = ahead.join(each, ahead[key].eqNullSafe(each["_key"]) & (ahead[place] == each["_p"]))
    inside = F.slice("_sims", 1, F.least(F.lit(reach), F.col("end") - 1 - F.col("_p")).cast("int"))
    sums = both.withColumn("_in", inside).groupBy(key, "start", "end").agg(F.sum(F.aggregate("_in", F.lit(0.0), lambda a, x: a + x)).alias("_s"), F.sum(F.size("_in")).alias("_n"))
    return sums.select(key, "start", "end", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(1.0).alias("avg_similarity"))


def nearby_mean(rows: DataFrame, key: str, place: str, vec: str, window: int = 3) -> DataFrame:
    """rows with `merged`: the mean of the vectors from window // 2 places before each row to as many after it, of those there are."""
    half = window // 2

    def add(w):
        near = F.collect_list(doubles(F.col(vec))).over(w.rowsBetween(-half, half))
        return {"_near": near}

    out = over_ranges(rows, key, place, half, half, add)
    total = F.aggregate(F.slice("_near", 2, F.greatest(F.lit(1), F.size("_near"))), F.element_at("_near", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return out.withColumn("merged", F.transform(total, lambda x: x / F.size("_near"))).drop("_near")


def scenes_by_similarity(sims: DataFrame, key: str, place: str, sim: str, least: float = 0.7) -> DataFrame:
    """key, scene, start, end, coherence: a scene ends where the similarity to the next row is below `least`.

    sims: a row per place of a key, from 0, with its similarity to the next one, null at the last. coherence: the mean
    similarity of neighbours within the scene, null for a single row.
    """
    broken = over_ranges(sims.select(key, place, sim), key, place, 1, 0, lambda w: {"_new": F.coalesce((F.lag(sim).over(w) < least).cast("long"), F.lit(0).cast("long"))})
    scened = running_sum(broken, key, place, F.col("_new"), "scene")
    inner = F.when(F.col(sim) >= least, F.col(sim))
    return scened.groupBy(key, "scene").agg(F.min(place).alias("start"), (F.max(place) + 1).alias("end"), F.avg(inner).alias("coherence"))


def scenes_by_count(rows: DataFrame, key: str, place: str, most: int) -> DataFrame:
    """key, scene, start, end: scenes of `most` rows each, by place from 0, the last one of the rest."""
    return rows.groupBy(key, F.floor(F.col(place) / most).alias("scene")).agg(F.min(place).alias("start"), (F.max(place) + 1).alias("end"))


def scenes_by_time(shots: DataFrame, key: str, start: str, end: str, most: float) -> DataFrame:
    """key, chunk, start_s, end_s, n: shots joined in order up to the one that ends `most` seconds or more after the scene's start."""
    return timeline.greedy_chunks(shots, [key], start, end, most, closing=True)
