"""Chunk files: JSON lists of chunks, bare or in an envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def read_chunks(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of schema, one per chunk of the files under path.

    A file holds a list, or an object with the list in `chunks` or, failing that, `all_chunks`. Files that hold neither
    give no rows.
    """
    text = spark.read.text(path, wholetext=True)
    many = ArrayType(schema)
    boxed = F.from_json("value", StructType([StructField("chunks", many), StructField("all_chunks", many)]))
    found = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", many)).otherwise(F.coalesce(boxed["chunks"], boxed["all_chunks"]))
    return text.select(F.explode(found).alias("_c")).select("_c.*")
