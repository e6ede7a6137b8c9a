"""Questions about time answered by spans, and how good the answers are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions import questions
from filmloom.operators.timeline import hull_iou

# The span without candidates, the confidence from which an answer counts as found, relevance where none is known.
DEFAULT_SPAN, LEAST, UNKNOWN = 60.0, 0.3, 0.5


def ground(asked: DataFrame, candidates: DataFrame, query: str, default_span: float = DEFAULT_SPAN) -> DataFrame:
    """query, kind, start_s, end_s, confidence, grounded, candidate: the best candidate of each question.

    asked: query, text. candidates: query, nth (their order), start_s, end_s, description, names, relevance, event_start.
    They are ranked by 0.6 of the score that the question's expression of time gives and 0.4 of their relevance, the first
    of equal ones; confidence is the product of both, to 3 places. Questions without candidates get the first default_span seconds.
    """
    parsed = asked.select(query, questions.expression(F.col("text")).alias("_e"))
    rows = candidates.join(parsed, query)
    rows = rows.withColumn("_sem", F.coalesce(F.col("relevance").cast("double"), F.lit(UNKNOWN)))
    rows = rows.withColumn("_time", questions.score(F.col("_e"), F.col("start_s"), F.col("end_s"), F.col("description"), F.col("names"), F.col("event_start")).cast("double"))
    best = F.min_by(F.struct("start_s", "end_s", "nth", "_time", "_sem"), F.struct(-questions.combined(F.col("_time"), F.col("_sem")), "nth"))
    top = rows.groupBy(F.col(query).alias("_q")).agg(best.alias("b"))
    sure = F.coalesce(F.col("b._time") * F.col("b._sem"), F.lit(0.0))
    out = parsed.join(top, parsed[query] == top["_q"], "left")
    there = F.col("b").isNotNull()
    return out.select(query, F.col("_e.kind").alias("kind"), F.when(there, F.col("b.start_s")).otherwise(0.0).alias("start_s"), F.when(there, F.col("b.end_s")).otherwise(default_span).alias("end_s"), F.round(sure, 3).alias("confidence"), (there & (sure >= LEAST)).alias("grounded"), F.col("b.nth").alias("candidate"))


def grounding_metrics(ranked: DataFrame, n_queries: int, query: str, rank: str, good: float = 0.5) -> DataFrame:
    """mean_iou, mrr, recall, rank1_share, n_queries over answers that are read in order up to each query's first good one.

    ranked: query, rank (from 1), start_s, end_s, true_start, true_end. mean_iou: of all answers read; mrr: of the rank at which
    reading ended; recall: queries with a good answer; rank1_share: of these, those whose first answer is good. A query
    without answers has a reciprocal rank of 0.
    """
    iou = ranked.withColumn("_iou", hull_iou(F.col("true_start"), F.col("true_end"), F.col("start_s"), F.col("end_s")))
    first = iou.groupBy(F.col(query).alias("_q")).agg(F.min(F.when(F.col("_iou") >= good, F.col(rank))).alias("_good"), F.max(rank).alias("_last"))
    read = iou.join(first, iou[query] == first["_q"]).where(F.col("_good").isNull() | (F.col(rank) <= F.col("_good")))
    per = read.groupBy(query).agg(F.sum("_iou").alias("_sum"), F.count("*").alias("_n"), F.first("_good").alias("_good"), F.first(F.coalesce("_good", "_last")).alias("_end"))
    n = F.lit(float(max(1, n_queries)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.agg(
        zero(F.sum("_sum") / F.sum("_n")).alias("mean_iou"), (zero(F.sum(1.0 / F.col("_end"))) / n).alias("mrr"), (F.count("_good") / n).alias("recall"), zero(F.try_divide(F.count_if(F.col("_good") == 1), F.count("_good"))).alias("rank1_share"), F.lit(n_queries).cast("long").alias("n_queries")
    )


def ranked_by(rows: DataFrame, query: str, score: str, tie: str, most: int) -> DataFrame:
    """The best `most` rows of each query with their rank from 1, of equal scores the smaller tie first."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
