"""Thinning and refining of ordered positions, and matches of normalised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.operators.timeline import interval_join


def thin(rows: DataFrame, key: str, place: str, most: int) -> DataFrame:
    """Of each key's rows, at places 0 to n - 1, all or `most` of them at even steps: the places floor(i * n / most).

    The number of a key's rows is a sum taken before the shuffle; no key is gathered or sorted.
    """
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    nth = F.ceil(F.col(place) * F.lit(float(most)) / F.col("_n"))
    keep = (F.col("_n") <= most) | ((nth < most) & (F.floor(nth * F.col("_n") / F.lit(float(most))) == F.col(place)))
    return rows.join(n, rows[key].eqNullSafe(n["_key"])).where(keep).drop("_key", "_n")


def min_duration(bounds: Column, duration: Column, least: float) -> Column:
    """Of rising bounds those that lie at least `least` beyond the last one kept, from 0 on, and within the duration."""
    step = lambda acc, b: F.when(b - acc["last"] < least, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(b)).alias("kept"), b.alias("last")))
    start = F.struct(F.array().cast("array<double>").alias("kept"), F.lit(0.0).alias("last"))
    kept = F.aggregate(F.coalesce(bounds, F.array().cast("array<double>")), start, step, lambda acc: acc["kept"])
    return F.filter(F.array_distinct(kept), lambda b: (b > 0) & (b < duration))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_]+", " "))


def matches_any(text: Column, expected: Column) -> Column:
    """Whether a text holds one of the expected ones, both in lower case with other characters than letters, digits and _ as spaces. An empty one matches nothing."""
    own = _plain(F.coalesce(text, F.lit("")))
    hit = F.exists(F.coalesce(expected, F.array().cast("array<string>")), lambda e: (_plain(e) != "") & F.contains(own, _plain(e)))
    return (own != "") & F.coalesce(hit, F.lit(False))


def pick_per_shot(frames: DataFrame, spans: DataFrame, key: str, span: str, shot: str, image: str, time: str, width: float = 60.0) -> DataFrame:
    """For each span the frames within it, ends included, one a shot: image 1 before 0 before 2 before others, then the nearest to the span's middle, then the earliest.

    spans: key, span, s0, s1; empty ones hold no frame. frames: key, shot, image, time.
    """
    at = frames.withColumn("_t", F.col(time).cast("double"))
    both = interval_join(at.withColumn("_t1", F.col("_t")), spans.where("s1 > s0"), key, ("_t", "s0"), ("_t1", "s1"), width)
    order = F.when(F.col(image) == 1, 0).when(F.col(image) == 0, 1).when(F.col(image) == 2, 2).otherwise(99)
    middle = F.abs(F.col("_t") - (F.col("s0") + F.col("s1")) / 2)
    best = both.groupBy(key, span, shot).agg(F.min_by(F.struct(*[F.col(c) for c in frames.columns if c not in (key, shot)]), F.struct(order, middle, "_t")).alias("f"))
    return best.select(key, span, shot, "f.*")
