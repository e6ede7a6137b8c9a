"""Helpers that the operators share: scratch tables in the shared folder and word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Drops a query's shuffle files as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Scratch tables that are still there.
_live: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_filmloom_scratch", None)
    if root:
        return root
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc._filmloom_scratch = tempfile.mkdtemp(prefix="filmloom-")
    return sc._filmloom_scratch


@contextmanager
def _settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings that hold within alone."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _write(spark: SparkSession, label: str, write, batch_bytes: int | None = None) -> str:
    """The path in the shared folder that write, called with it, has filled; it goes when the session ends.

    batch_bytes: about so many bytes reach Python at a time, and a row at least.
    """
    path = os.path.join(shared_dir(spark), f"filmloom-{label}-{uuid.uuid4().hex}")
    with _settings(spark, {CLEAN_UP: "true", **({BATCH_BYTES: batch_bytes} if batch_bytes else {})}):
        write(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _live.add(path)
    return path


def materialise(df: DataFrame, label: str, free: tuple[DataFrame, ...] = (), batch_bytes: int | None = None, **options: object) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps start from files that outlive executors.

    free: tables from earlier calls that nothing needs any more; their files go once df is written. batch_bytes: for df's
    Python functions, the size of a batch. options: the writer's.
    """
    path = _write(df.sparkSession, label, df.write.options(**options).parquet, batch_bytes)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._filmloom_path = path
    drop(*free)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() returned. Only when no later step reads them."""
    for t in tables:
        drop_path(t.sparkSession, t._filmloom_path)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _live.discard(path)


@contextmanager
def scratch_made() -> Iterator[set[str]]:
    """The paths of scratch tables that are made within and not dropped: at its end, what a result may still read."""
    before, out = set(_live), set()
    yield out
    out |= _live - before


def parts_for(docs: DataFrame, text_col: str, each: int = 32 << 20) -> int:
    """So many partitions that each gets about `each` bytes of text, and at least the session's number of them."""
    size = docs.agg(F.sum(F.octet_length(F.col(quoted(text_col))))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // each))


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """An id and a text column as _id and _text: functions that map batches take no names with dots."""
    return docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"))


@contextmanager
def bucketed(df: DataFrame, key: str, label: str, buckets: int) -> Iterator[DataFrame]:
    """Like materialise, in buckets of key: joins on key don't shuffle this side. For keys without hot values; its files go at the end."""
    spark, name = df.sparkSession, f"filmloom_{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    path = _write(spark, label, lambda path: writer.option("path", path).saveAsTable(name))
    try:
        out = spark.table(name)
        out._filmloom_path = path
        yield out
        drop(out)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_white_space(text: Column) -> Column:
    for ch in WS:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def n_words(text: Column) -> Column:
    """Number of maximal runs of other characters than WS; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")
