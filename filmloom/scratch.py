"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Drops a query's shuffle files as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_filmloom_scratch", None)
    if not root:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = sc._filmloom_scratch = tempfile.mkdtemp(prefix="filmloom-")
    return root


def new_path(spark: SparkSession, label: str) -> str:
    """A path of the shared folder that nothing else has; it goes when the session ends."""
    path = os.path.join(shared_folder(spark), f"filmloom-{label}-{uuid.uuid4().hex}")
    _delete(spark, path, at_end=True)
    return path


def _delete(spark: SparkSession, path: str, at_end: bool = False) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(target) if at_end else fs.delete(target, True)


def written(df: DataFrame, label: str, *free: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what reads it outlives executors. free: earlier such tables that nothing needs any more."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    dropped(*free)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that written() returned; others stay."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            _delete(t.sparkSession, path)
