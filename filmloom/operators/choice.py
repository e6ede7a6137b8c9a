"""Greedy choices: one partner for each of two sides, and a few rows that cover a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.functions.vectors import doubles
from filmloom.scratch import dropped, written

#: Pairs of a group that one task assigns by itself.
ALONE = 100_000


def assign(pairs: DataFrame, group: str, left: str, right: str, score: str, alone: int | None = None) -> DataFrame:
    """group, left, right, score: in order of left, each takes the best right of its group that none before it took.

    Of equal scores the smaller right is best; scores of -1 or less, or null ones, are no pairs. Groups of at most `alone`
    pairs are assigned in one task each. Larger ones take rounds: every left asks for its best right; a right keeps the
    first of those who ask for good against all later ones, whose pairs with it go. Who is left asks again, and when none
    was refused, all have what they would have taken in turn.
    """
    alone = ALONE if alone is None else alone
    rows = written(pairs.where(F.col(score) > -1).select(F.col(group).alias("g"), F.col(left).alias("i"), F.col(right).alias("j"), F.col(score).cast("double").alias("s")), "pairs")
    # One row per `alone` pairs at most, so it is broadcast: a join by group would bring all of a large group to one task.
    large = F.broadcast(written(rows.groupBy(F.col("g").alias("_g")).count().where(F.col("count") > alone).select("_g"), "large"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def in_turn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("i", "s", "j")), range(table.num_rows)), key=lambda r: (r[0], -r[1], r[2]))
        taken, done, keep = set(), object(), []
        for i, _, j, at in rows:
            if i != done and j not in taken:
                taken.add(j)
                keep.append(at)
                done = i
        return table.take(pa.array(keep, pa.int64()))

    small = rows.join(large, F.col("g").eqNullSafe(F.col("_g")), "left_anti").groupBy("g").applyInArrow(in_turn, shape)
    open_, best = written(rows.join(large, F.col("g").eqNullSafe(F.col("_g")), "left_semi"), "open"), None
    while True:
        top = open_.groupBy("g", "i").agg(F.min_by(F.struct("j", "s"), F.struct(-F.col("s"), "j")).alias("t"))
        top = written(top.select("g", "i", "t.j", "t.s"), "top")
        first = top.groupBy(F.col("g").alias("_g"), F.col("j").alias("_j")).agg(F.min("i").alias("_first"))
        kept = lambda df: df.join(first, df["g"].eqNullSafe(first["_g"]) & (df["j"] == first["_j"]), "left").where(F.col("_first").isNull() | (F.col("i") <= F.col("_first"))).select("g", "i", "j", "s")  # noqa: B023, E731
        best = written(kept(top), "kept")
        if best.count() == top.count():
            dropped(open_, top)
            break
        open_ = written(kept(open_), "open", open_, best)
        dropped(top)
    return small.unionByName(best).select(F.col("g").alias(group), F.col("i").alias(left), F.col("j").alias(right), F.col("s").alias(score))


def cover(rows: DataFrame, group: str, place: str, vec: str, relevance: str, time: str, most: int = 50, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """The rows chosen to stand for their group, with `chosen`, the turn in which each was.

    A group of at most `most` rows stays whole (chosen is its place). Else the most relevant row is first, the earliest
    of equal ones; each further turn tries every step-th of the rows that are left, about a hundred, and takes the one
    with the best sum of weights times relevance, coverage (1 - its largest similarity to a chosen row) and diversity (0.7
    times 1 - the mean similarity, 0.3 times the time to the nearest chosen row as a share of the group's). Places of a
    group run from 0 without gaps. Only rows whose place a turn can try, at most about 100 * most times two, reach the
    group's task: a turn's steps begin at 0 and are moved on by the rows taken before, at most `most` of them.
    """
    n = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.min(time).alias("_t0"), F.max(time).alias("_t1"), F.min_by(place, F.struct(-F.col(relevance), F.col(place))).alias("_top"))
    sized = rows.join(n, rows[group].eqNullSafe(n["_g"]))
    steps = F.sequence(F.greatest(F.lit(1), F.floor((F.col("_n") - most) / 100)), F.greatest(F.lit(1), F.floor(F.col("_n") / 100)))
    tried = F.exists(steps, lambda s: F.col(place) % s <= most)
    near = sized.where((F.col("_n") <= most) | (F.col(place) == F.col("_top")) | tried)
    kind = rows.schema[group].dataType.simpleString()
    few = near.select(F.col(group).alias("g"), F.col(place).cast("long").alias("place"), doubles(F.col(vec)).alias("v"), F.col(relevance).cast("double").alias("r"), F.col(time).cast("double").alias("t"), "_n", (F.col("_t1") - F.col("_t0")).cast("double").alias("span"))

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        at, r, t = (table.column(c).to_numpy() for c in ("place", "r", "t"))
        size, span = table.column("_n")[0].as_py(), table.column("span")[0].as_py()
        if size <= most:
            chosen = list(range(size))
        else:
            v = np.array(table.column("v").to_pylist(), float)
            row = {int(p): k for k, p in enumerate(at)}
            chosen = [int(np.argmax(r))]
            while len(chosen) < most:
                gone, left = np.sort(at[chosen]), size - len(chosen)
                step = left // 100 if left > 100 else 1
                nth = np.arange(0, left, step)
                # the place of the nth that is left: as many further as places at or before it are gone
                k = np.array([row[int(p)] for p in nth + np.searchsorted(gone - np.arange(len(gone)), nth, "right")])
                sim = v[k] @ v[chosen].T
                away = np.abs(t[k, None] - t[chosen]).min(1) / (span + 1e-8)
                value = weights[0] * r[k] + weights[1] * (1 - sim.max(1)) + weights[2] * (0.7 * (1 - sim.mean(1)) + 0.3 * away)
                chosen.append(int(k[np.argmax(value)]))
        return pa.table({"g": table.column("g").take(pa.array(chosen)), "place": pa.array(at[chosen]), "chosen": pa.array(range(len(chosen)), pa.int32())})

    taken = few.groupBy("g").applyInArrow(choose, f"g {kind}, place long, chosen int").withColumnsRenamed({"g": "_g", "place": "_place"})
    return rows.join(taken, rows[group].eqNullSafe(taken["_g"]) & (rows[place] == taken["_place"])).drop("_g", "_place")
