"""A table whose keys are replaced whole, in commits that readers see whole; and chunk files of each key."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class KeyedTable:
    """Rows by key under `root`: batches of rows, owners (which batch holds a key's rows) and numbered versions.

    A write adds a batch and the owners after it, and then commits by creating the next version's file, which only one writer
    can. Readers take the newest version alone: they see all of a write or nothing, and never a row that a later write of
    its key has replaced. What an interrupted write left is not part of any version.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path(os.path.join(self.root, *parts) if any(parts) else self.root)

    def version(self) -> int:
        """The newest version, 0 before the first."""
        folder = self._path("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max([0, *(int(n) for n in names if n.isdigit())])

    def _state(self, version: int) -> dict:
        if not version:
            return {"owners": None, "batches": [], "schema": None}
        stream = self._fs.open(self._path("versions", f"{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, state: dict) -> None:
        """Create the version's file whole: written aside, then renamed, which fails if it is there."""
        aside, target = self._path("versions", f"_{uuid.uuid4().hex}"), self._path("versions", f"{version:012d}")
        self._fs.mkdirs(self._path("versions"))
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} of {self.root} was committed by another writer")

    def _owners(self, state: dict) -> DataFrame | None:
        return self.spark.read.parquet(os.path.join(self.root, "owners", state["owners"])) if state["owners"] else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is given; None before the first."""
        state = self._state(self.version() if version is None else version)
        if not state["owners"]:
            return None
        schema = StructType.fromJson(state["schema"])
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(os.path.join(self.root, "rows", b)).withColumn("_batch", F.lit(b)) for b in state["batches"]])
        owners = self._owners(state).select(F.col("key").alias("_key"), F.col("batch").alias("_owner"))
        return rows.join(owners, rows[self.key].eqNullSafe(owners["_key"]) & (F.col("_batch") == F.col("_owner"))).drop("_batch", "_key", "_owner")

    def upsert(self, incoming: DataFrame, gone: DataFrame | None = None, tries: int = 5) -> int:
        """Replace the rows of every key that incoming has, drop those of the keys in gone (a column `key`), and return the version.

        Columns that earlier rows lack are null there. A writer that is overtaken builds the owners anew on the newer version.
        """
        batch = uuid.uuid4().hex
        incoming.write.parquet(os.path.join(self.root, "rows", batch))
        own = self.spark.read.schema(incoming.schema).parquet(os.path.join(self.root, "rows", batch))
        new = own.select(F.col(self.key).alias("key")).distinct().withColumn("batch", F.lit(batch))
        replaced = new.select(F.col("key").alias("_k")) if gone is None else new.select(F.col("key").alias("_k")).union(gone.select("key")).distinct()
        for _ in range(tries):
            at = self.version()
            state = self._state(at)
            old = self._owners(state)
            kept = new if old is None else old.join(replaced, old["key"].eqNullSafe(replaced["_k"]), "left_anti").unionByName(new)
            name = uuid.uuid4().hex
            kept.write.parquet(os.path.join(self.root, "owners", name))
            live = [r["batch"] for r in self.spark.read.parquet(os.path.join(self.root, "owners", name)).select("batch").distinct().collect()]
            known = StructType.fromJson(state["schema"]) if state["schema"] else StructType()
            schema = StructType([*known, *(f for f in incoming.schema if f.name not in known.names)])
            order = [b for b in [*state["batches"], batch] if b in set(live)]
            try:
                self._commit(at + 1, {"owners": name, "batches": order or [batch], "schema": schema.jsonValue()})
                return at + 1
            except Conflict:
                continue
        raise Conflict(f"{self.root} is written by others all the time")

    def compact(self) -> int:
        """Rewrite the live rows as one batch; the number of batches that a read unites is that of the writes since."""
        rows = self.read()
        return self.upsert(rows) if rows is not None else 0


def write_chunk_files(chunks: DataFrame, folder: str, key: str) -> None:
    """JSON lines in a folder for each key, `key`=value; the folders of keys that chunks lacks stay as they are."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(folder)
