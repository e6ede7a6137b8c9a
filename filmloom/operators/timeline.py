"""Interval and sequence operators on a timeline: overlap joins, nearest joins, presence, edges, arcs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def hull_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the hull of both intervals; 0 for an empty hull."""
    return F.coalesce(F.try_divide(overlap(a0, a1, b0, b1), F.greatest(a1, b1) - F.least(a0, b0)), F.lit(0.0))


def interval_join(left: DataFrame, right: DataFrame, key: str, lo: tuple[str, str], hi: tuple[str, str], width: float) -> DataFrame:
    """Closed-interval join within key: each side goes to the bins of `width` that it touches; a pair counts in its first common bin.

    Cost follows the bins that overlap, not the product of the sides; width should be near the longer side's usual length.
    """
    (l0, r0), (l1, r1) = lo, hi
    cell = lambda c: F.floor(F.col(c) / width)
    a = left.withColumn("_bin", F.explode(F.sequence(cell(l0), cell(l1))))
    b = right.withColumn("_bin", F.explode(F.sequence(cell(r0), cell(r1))))
    both = a.join(b, [key, "_bin"]).where((F.col(l1) >= F.col(r0)) & (F.col(l0) <= F.col(r1)))
    return both.where(F.col("_bin") == F.greatest(cell(l0), cell(r0))).drop("_bin")


def nearest_join(left: DataFrame, right: DataFrame, key: str, t_left: str, t_right: str, id_right: str, most: float) -> DataFrame:
    """For each left row the id and time of the right row nearest in time within key, at most `most` away, earlier first on ties.

    One window over the union of both sides: the last right row before and the first after each left row.
    """
    cols = left.columns
    side = left.select(*cols, F.col(t_left).alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast(right.schema[id_right].dataType).alias("_id"))
    other = right.select(F.col(key), F.col(t_right).alias("_t"), F.lit(0).alias("_s"), F.col(id_right).alias("_id"))
    both = side.unionByName(other, allowMissingColumns=True)
    hit = F.when(F.col("_s") == 0, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    back = Window.partitionBy(key).orderBy("_t", "_s", F.col("_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("_t", F.col("_s").desc(), "_id").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_b", F.last(hit, ignorenulls=True).over(back)).withColumn("_a", F.first(hit, ignorenulls=True).over(ahead)).where("_s = 1")
    db, da = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    pick = F.when(F.col("_b").isNull() | (da < db), F.col("_a")).otherwise(F.col("_b"))
    both = both.withColumn("_p", pick).withColumn("_d", F.abs(F.col("_p.t") - F.col("_t")))
    near = F.col("_d") <= most
    return both.select(*cols, F.when(near, F.col("_p.id")).alias(f"near_{id_right}"), F.when(near, F.col("_d")).alias("distance"))


def presence(df: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """Runs of rows at most gap apart within keys: segment number, start, end, rows."""
    w = Window.partitionBy(*keys).orderBy(t)
    new = (F.col(t) - F.lag(t).over(w) > gap).cast("int")
    runs = df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("segment", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "segment").agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.count("*").alias("n"))


def arc_by_ratio(x: Column) -> Column:
    return F.when(x < 0.15, "exposition").when(x < 0.4, "rising_action").when(x < 0.65, "climax").when(x < 0.85, "falling_action").otherwise("resolution")


def cue_text(chunks: DataFrame, cues: DataFrame, key: str, chunk_id: str, share: float, least: float, near: float, width: float) -> DataFrame:
    """chunks with `cues`, the texts of the cues of a chunk in order of time.

    chunks: key, chunk_id, s0, s1; cues: key, cue_id, c0, c1, text. A cue belongs to a chunk if it covers `share` of it
    (counted as a second at least) or overlaps it by `least` seconds. A chunk with no such cue takes those that start
    less than `near` seconds from its own start; with none of these either, its text is empty.
    """
    both = interval_join(cues, chunks, key, ("c0", "s0"), ("c1", "s1"), width)
    shared = overlap(F.col("c0"), F.col("c1"), F.col("s0"), F.col("s1"))
    own = both.where((shared >= share * F.greatest(F.col("s1") - F.col("s0"), F.lit(1.0))) | (shared >= least))
    own = own.select(chunk_id, "c0", "cue_id", "text")
    rest = chunks.join(own.select(chunk_id).distinct(), chunk_id, "left_anti")
    rest = rest.withColumn("n0", F.col("s0") - near).withColumn("n1", F.col("s0") + near)
    by = interval_join(cues.withColumn("p", F.col("c0")), rest, key, ("c0", "n0"), ("p", "n1"), width)
    by = by.where(F.abs(F.col("c0") - F.col("s0")) < near).select(chunk_id, "c0", "cue_id", "text")
    said = own.union(by).groupBy(chunk_id).agg(F.array_sort(F.collect_list(F.struct("c0", "cue_id", "text"))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda c: c["text"]), " ")
    return chunks.join(said, chunk_id, "left").withColumn("cues", F.coalesce(text, F.lit(""))).drop("_all")


def greedy_chunks(df: DataFrame, keys: list[str], start: str, end: str, most: float, closing: bool = False) -> DataFrame:
    """Segments of each key joined in order of start while they span at most `most` seconds: chunk, start_s, end_s, n.

    With closing, a segment whose end lies `most` seconds or more after its chunk's start is the last one of the chunk.

    Where a chunk ends depends on where it began, which no window expresses. But one always ends where the next end is
    more than `most` after the start before, so a window first cuts each key there. Rows are dealt by key and cut, sorted,
    and read in one pass that keeps a chunk at a time, however long a part without a cut is. Rows with a null start or end go.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    names, ids = [f"_k{i}" for i in range(len(keys))], [*range(len(keys)), len(keys)]
    out = pa.schema([*((n, to_arrow_type(kinds[k])) for n, k in zip(names, keys)), ("_cut", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # a part's key and cut, the start, end and rows of its open chunk, and its last row's end
        for b in batches:
            done = []
            key = [b.column(i).to_pylist() for i in ids]
            for *k, s, e in zip(*key, b.column(len(ids)).to_pylist(), b.column(len(ids) + 1).to_pylist()):
                if held and held[0] == k and (held[4] - held[1] < most if closing else max(held[2], e) - held[1] <= most):
                    held[2:] = max(held[2], e), held[3] + 1, e
                else:
                    done += [held] if held else []
                    held = [k, s, e, 1, e]
            if done:
                yield as_batch(done)
        if held:
            yield as_batch([held])

    def as_batch(done: list[list]) -> pa.RecordBatch:
        rows = [[*k, *rest] for k, *rest, _ in done]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = rows.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"))
    w = Window.partitionBy(*names).orderBy("_s", "_e")
    cut = F.lag(F.col("_e") - F.col("_s") >= most).over(w) if closing else F.col("_e") - F.lag("_s").over(w) > most
    rows = rows.withColumn("_gap", F.coalesce(cut.cast("long"), F.lit(0).cast("long"))).withColumn("_cut", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = rows.select(*names, "_cut", "_s", "_e").repartition(*names, "_cut").sortWithinPartitions(*names, "_cut", "_s", "_e")
    found = dealt.mapInArrow(run, ", ".join(f"{n} {kinds[k].simpleString()}" for n, k in zip(names, keys)) + ", _cut long, start_s double, end_s double, n long")
    chunk = F.row_number().over(Window.partitionBy(*names).orderBy("start_s", "end_s")) - 1
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], chunk.cast("int").alias("chunk"), "start_s", "end_s", "n")
