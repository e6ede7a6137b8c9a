"""Vector column functions: JVM-side folds over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def mean_vector(df, key: str, vec: str, normalise: bool = False):
    """Element-wise mean of vec per key, as an array in place order; optionally scaled to length one."""
    parts = df.select(key, F.posexplode(doubles(F.col(vec))).alias("_i", "_x"))
    means = parts.groupBy(key, "_i").agg(F.avg("_x").alias("_m"))
    out = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vec))
    return out.withColumn(vec, scaled(F.col(vec), 1.0 / norm(F.col(vec)))) if normalise else out
