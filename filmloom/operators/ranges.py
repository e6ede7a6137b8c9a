"""Places, windows and running sums within a key, with a hot key dealt to many tasks by ranges of its order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from filmloom.scratch import written

#: Places of a range.
SIZE = 8192


def placed(df: DataFrame, key: str, *order: str, name: str = "place") -> DataFrame:
    """df with each row's place, from 0, in its key's order; equal rows in any order. A null key is a key.

    Rows are dealt by ranges of key and order, so a key may lie in many partitions, and numbered within these; how many
    of a key lie in earlier partitions comes from counts, a row per key and partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "places")
    first = rows.groupBy(F.col(key).alias("_key"), "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("_key", F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    out = rows.join(first, rows[key].eqNullSafe(first["_key"]) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_key", "_p", "_shift")


def over_ranges(df: DataFrame, key: str, place: str, before: int, after: int, add: Callable[[WindowSpec], dict[str, Column]], size: int | None = None) -> DataFrame:
    """df with the columns of `add`, called with the window of a key by place; they look at most `before` rows back and `after` ahead.

    Places run from 0 without gaps. A key is cut into ranges of `size` places; rows near an edge also go to the range
    beyond it, for its windows alone, so no window reads a whole key.
    """
    size = size or SIZE
    to = F.sequence(F.greatest(F.lit(0), F.floor((F.col(place) - after) / size)), F.floor((F.col(place) + before) / size))
    rows = df.withColumn("_range", F.explode(to))
    w = Window.partitionBy(key, "_range").orderBy(place)
    return rows.withColumns(add(w)).where(F.floor(F.col(place) / size) == F.col("_range")).drop("_range")


def running_sum(df: DataFrame, key: str, place: str, value: Column, name: str, size: int | None = None) -> DataFrame:
    """df with the sum of value over a key's rows up to each one's place: sums of ranges first, then within a range."""
    size = size or SIZE
    rows = df.withColumn("_v", value).withColumn("_range", F.floor(F.col(place) / size))
    sums = rows.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.sum("_v").alias("_s"))
    earlier = F.sum("_s").over(Window.partitionBy("_key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_key", "_r", F.coalesce(earlier, F.lit(0)).alias("_base"))
    out = rows.join(sums, rows[key].eqNullSafe(sums["_key"]) & (F.col("_range") == F.col("_r")))
    own = F.sum("_v").over(Window.partitionBy(key, "_range").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.col("_base") + F.coalesce(own, F.lit(0))).drop("_v", "_range", "_key", "_r", "_base")


def percentile(df: DataFrame, key: str, value: str, share: float, name: str) -> DataFrame:
    """key, name: of each key's values the one at `share` of their order, between two of them in proportion; nulls are left out."""
    rows = placed(df.where(F.col(value).isNotNull()).select(key, value), key, value, name="_place")
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).withColumn("_x", (F.col("_n") - 1) * share)
    near = rows.join(n, rows[key].eqNullSafe(n["_key"])).where((F.col("_place") == F.floor("_x")) | (F.col("_place") == F.ceil("_x")))
    low, high = F.min(value), F.max(value)
    return near.groupBy(key).agg((low + (high - low) * (F.first("_x") - F.floor(F.first("_x")))).alias(name))
