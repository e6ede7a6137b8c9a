"""Grades of ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = 3
#: Appearances of a part, about.
PART = 500_000


def grade(results: DataFrame, key: str, rank: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Of each key's results those with a score of threshold or more, else its first KEEP, with avg_score of all and needs_rewrite.

    needs_rewrite: the average is under the threshold and fewer than two results stay. A null score counts as 0. Sums
    come before the shuffle; a key's results are never gathered.
    """
    rows = results.withColumn("_s", F.coalesce(F.col(score), F.lit(0.0)))
    per = rows.groupBy(F.col(key).alias("_key")).agg(F.avg("_s").alias("avg_score"), F.count("*").alias("_n"), F.sum(F.when(F.col("_s") >= threshold, 1).otherwise(0)).alias("_over"))
    stay = F.when(F.col("_over") > 0, F.col("_over")).otherwise(F.least("_n", F.lit(KEEP)))
    per = per.withColumn("needs_rewrite", (F.col("avg_score") < threshold) & (stay < 2))
    out = rows.join(per, rows[key].eqNullSafe(per["_key"]))
    return out.where(F.when(F.col("_over") > 0, F.col("_s") >= threshold).otherwise(F.col(rank) <= KEEP)).drop("_s", "_key", "_n", "_over")


def groups_of_entity(appearances: DataFrame, entity: str, group: str, scene: str) -> DataFrame:
    """entity, group, scene_count: in how many different scenes of each group an entity appears.

    Rows are dealt by scene into parts of about PART, each of which drops its repeats and counts by itself; only counts are
    shuffled after that. How many rows there are is counted first, so a part's memory does not follow the table's size.
    """
    rows = appearances.select(entity, group, scene)
    parts = -(-rows.count() // PART) or 1
    each = rows.repartition(parts, scene).distinct()
    return each.groupBy(entity, group).agg(F.count("*").alias("scene_count"))
