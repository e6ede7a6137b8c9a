"""Ingest of many items in batches, with a state for each that a killed run goes on from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.sinks.keyed import KeyedTable

#: What an item can be.
PENDING, RUNNING, COMPLETED, FAILED, INCOMPLETE = "pending", "running", "completed", "failed", "incomplete"
STATE = "item string, status string, attempt_count int, last_error string"


class Ingest:
    """Items go through `step` in batches; `manifest` holds their states, `target` what a step gives.

    step takes a DataFrame of items (a column `item`) and gives rows with target's key, the item. A batch is first marked as
    running, then its rows are put into target in one commit that replaces all earlier rows of these items, then it is
    marked as completed; items without a row are incomplete. A run that dies in between leaves items running; the next run
    takes them again, and as their rows are replaced whole, the result is that of one clean run. A step that raises marks
    its batch as failed and the run goes on; failed and incomplete items are taken again by a later run, up to `attempts`.
    """

    def __init__(self, manifest: KeyedTable, target: KeyedTable, step: Callable[[DataFrame], DataFrame], batches: int = 8, attempts: int = 3):
        self.manifest, self.target, self.step, self.batches, self.attempts = manifest, target, step, batches, attempts

    def add(self, items: DataFrame) -> None:
        """Items (a column `item`) that the manifest lacks are pending."""
        known, new = self.manifest.read(), items.where("item IS NOT NULL").select(F.col("item").cast("string")).distinct()
        new = new if known is None else new.join(known, "item", "left_anti")
        self.manifest.upsert(new.selectExpr("item", f"'{PENDING}' AS status", "0 AS attempt_count", "CAST(NULL AS STRING) AS last_error"))

    def open_items(self) -> DataFrame:
        again = F.col("status").isin(FAILED, INCOMPLETE) & (F.col("attempt_count") < self.attempts)
        return self.manifest.read().where(F.col("status").isin(PENDING, RUNNING) | again)

    def _mark(self, items: DataFrame, status: str, error: str | None = None, more: int = 0) -> None:
        self.manifest.upsert(items.select("item", F.lit(status).alias("status"), (F.col("attempt_count") + more).cast("int").alias("attempt_count"), F.lit(error).cast("string").alias("last_error")))

    def run(self) -> dict[str, int]:
        """Take all open items once, and give the number of items in each state."""
        todo = self.manifest.version()
        for b in range(self.batches):
            part = F.pmod(F.xxhash64("item"), F.lit(self.batches)) == b
            again = F.col("status").isin(FAILED, INCOMPLETE) & (F.col("attempt_count") < self.attempts)
            mine = self.manifest.read(todo).where((F.col("status").isin(PENDING, RUNNING) | again) & part)
            if mine.isEmpty():
                continue
            self._mark(mine, RUNNING, more=1)
            running = self.manifest.read(self.manifest.version()).where((F.col("status") == RUNNING) & part)
            try:
                self.target.upsert(self.step(running.select("item")), gone=running.select(F.col("item").alias("key")))
            except Exception as e:  # noqa: BLE001  whatever a step raises is its items' state
                self._mark(running, FAILED, f"{type(e).__name__}: {e}"[:500])
                continue
            made = self.target.read().select(F.col(self.target.key).alias("item")).distinct()
            self._mark(running.join(made, "item", "left_semi"), COMPLETED)
            missing = running.join(made, "item", "left_anti")
            if not missing.isEmpty():
                self._mark(missing, INCOMPLETE, "no rows")
        return self.summary()

    def summary(self) -> dict[str, int]:
        return {r["status"]: r["count"] for r in self.manifest.read().groupBy("status").count().collect()}
