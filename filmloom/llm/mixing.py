"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is a number of words; each of its documents should be taken target / size times. The whole part of
that is taken for certain; what is left is a probability p in [0, 1). Documents of a source are rounded in pairs: words
move from one to the other, at random but with the right odds, until one of the two is taken or left out for good. A
pair's words are kept by each move, so a group's words are too, but for its last undecided document. A group is a
bounded part of a source (documents dealt by hash); the groups' undecided documents meet again in groups of FAN_IN, in
a tree, until each source has one, which is rounded to the nearer side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, n_words, quoted, read_table

GROUP_ROWS = 2000
FAN_IN = 1000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Sources are few; beyond so many the table of targets would no longer be a small one.
MOST_SOURCES = 1_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: share of all words by weight, at most `most` times a source's own, the excess reshared by weight."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i]
        left -= sum(out[i] for i in full)
        open_ = open_ - full if full else set()
    return out


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """p rounded to 0 or 1 but for at most one document, whose place comes second (-1: none)."""
    p, at = p.copy(), -1
    for j in np.flatnonzero((p > 0) & (p < 1)):
        if at < 0:
            at = j
            continue
        # Words that can move from j to at, and from at to j.
        up, down = min((1 - p[at]) * size[at], p[j] * size[j]), min(p[at] * size[at], (1 - p[j]) * size[j])
        move = up if draws[j] * (up + down) < down else -down
        p[at] += move / size[at]
        p[j] -= move / size[j]
        for k in (at, j):
            if min(abs(p[k]), abs(1 - p[k])) * size[k] < 1e-6:
                p[k] = round(p[k])
        at = at if 0 < p[at] < 1 else j if 0 < p[j] < 1 else -1
    return p, at


_GROUP = "_source string, _group long, _row long, _size long, _p double, _draw double"


def _round_groups(rows: DataFrame) -> DataFrame:
    """rows (_GROUP) with _p rounded in each group; the undecided keep theirs. Larger documents are decided first."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_size", "_draw", "_row"], ascending=[False, True, True], ignore_index=True)
        g["_p"], _ = pivot(g["_p"].to_numpy(np.float64), g["_size"].to_numpy(np.float64), g["_draw"].to_numpy(np.float64))
        return g

    return rows.groupBy("_source", "_group").applyInPandas(run, _GROUP)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, copies, taken (copies * size), and the columns in carry.

    Sources take weights in order of code point, a null source last; weights repeat. A null or empty text has size 0 and
    is not taken. Reruns agree: draws come from a hash of the row and the seed, and rows that tie in all of source, id,
    size and draw are alike. A table without words takes nothing; an empty one gives an empty result.
    """
    spark, own, text = docs.sparkSession, F.col(quoted(id_col)), F.col(quoted(text_col))
    rows = docs.select(own.alias("_id"), *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(quoted(source_col)).cast("string").alias("_source"), n_words(text).alias("_size"), F.xxhash64(F.lit(seed), own, text).alias("_hash"))
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    per = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(per) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    per = sorted(per, key=lambda r: (r["_source"] is None, r["_source"] or ""))
    goal = targets([r["size"] for r in per], [weights[i % len(weights)] for i in range(len(per))], share, most)
    table = [(r["_source"], r["size"], t, t / r["size"] if r["size"] else 0.0, -(-r["n"] // GROUP_ROWS)) for r, t in zip(per, goal, strict=True)]
    table = spark.createDataFrame(table, "_source string, source_size long, target double, _times double, _groups long")
    whole = rows.join(F.broadcast(table), rows["_source"].eqNullSafe(table["_source"])).drop(table["_source"])
    whole = whole.withColumn("_sure", F.when(F.col("_size") > 0, F.floor("_times")).otherwise(F.lit(0)).cast("long"))
    draw = F.pmod(F.xxhash64(F.col("_hash"), F.lit("draw")), F.lit(1 << 53)).cast("double") / float(1 << 53)
    p = F.when(F.col("_size") > 0, F.col("_times") - F.col("_sure")).otherwise(F.lit(0.0))
    open_ = whole.select("_source", F.pmod("_hash", F.col("_groups")).alias("_group"), F.col("_row"), "_size", p.alias("_p"), draw.alias("_draw")).where("_p > 0")
    deep, groups, decided = 0, max([1, *(-(-r["n"] // GROUP_ROWS) for r in per)]), []
    while True:
        done = materialise(_round_groups(open_), f"pivot{deep}")
        decided.append(done.where("_p = 0 or _p = 1"))
        rest = done.where("_p > 0 and _p < 1")
        if groups == 1:
            decided.append(rest.withColumn("_p", F.when(F.col("_p") < 0.5, 0.0).otherwise(1.0)))
            break
        groups, deep = -(-groups // FAN_IN), deep + 1
        open_ = rest.withColumn("_group", (F.col("_group") / FAN_IN).cast("long"))
    extra = reduce(DataFrame.unionByName, decided).where("_p = 1").select("_row", F.lit(1).alias("_one"))
    # What is decided grows with the documents: it is joined by their rows at every size, never sent to all tasks.
    out = whole.join(extra.hint("merge"), "_row", "left").withColumn("copies", F.col("_sure") + F.coalesce("_one", F.lit(0)))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: the rows of docs, each as often as mix() takes it, with all columns."""
    inner = docs.select(*[F.col(quoted(c)).alias(f"_x{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_x{i}" for i, c in enumerate(docs.columns)}
    out = mix(inner, at[id_col], at[text_col], at[source_col], carry=[c for c in inner.columns if c != at[id_col]], **options).where("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("copies")
