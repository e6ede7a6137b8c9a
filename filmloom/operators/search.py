"""Exact vector search and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions.vectors import dot, doubles
from filmloom.operators.ranges import placed

#: Queries that are multiplied with a batch of rows at a time, and rows of a batch; queries whose scores are held at a time.
BLOCK, ROWS, STRIP = 512, 4096, 64


def topk_one(rows: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Top k rows by inner product with the single query row (columns q_id, q); a one-row side, so a broadcast one."""
    scored = rows.join(F.broadcast(query.limit(1))).where("vec_id <> q_id")
    scored = scored.select("vec_id", "label", F.round(dot(doubles(F.col("embedding")), F.col("q")), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def _numbers(df: DataFrame) -> list:
    return [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>" if "float" in df.schema["embedding"].dataType.simpleString() else "array<double>").alias("e")]


def _gathered(side: str, *more: str) -> list:
    """Ids, labels and vectors of a block's rows m, the vectors one after another: flat arrays, which a task reads without a copy."""
    return [F.col("m.vec_id").alias(f"{side}_ids"), F.col("m.label").alias(f"{side}_labels"), F.flatten("m.e").alias(f"{side}_vectors"), *[F.col(f"m.{c}").alias(f"{side}_{c}") for c in more]]


def _packed(df: DataFrame, side: str, most: int, same_label: bool = False, *more: str) -> DataFrame:
    """Rows in blocks of about `most`; with same_label, of one _label each."""
    keys = ["_label"] if same_label else []
    n = -(-df.count() // most) or 1
    rows = df.select(*_numbers(df), *more, *[F.col("label").alias(k) for k in keys], F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("_part"))
    return rows.groupBy("_part", *keys).agg(F.collect_list(F.struct("vec_id", "label", "e", *more)).alias("m")).select(*keys, *_gathered(side, *more))


def _met(own: DataFrame, asked: DataFrame, same_label: bool = False) -> DataFrame:
    """Every block of rows with every block of queries, or with those of its label."""
    return own.join(asked, "_label").drop("_label") if same_label else own.crossJoin(asked)


def _block(b: pa.RecordBatch, r: int, side: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    ids = b.column(f"{side}_ids")[r].values.to_numpy(zero_copy_only=False)
    return ids, b.column(f"{side}_labels")[r].values, b.column(f"{side}_vectors")[r].values.to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)


def _strips(b: pa.RecordBatch) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Of each pair of blocks, some queries at a time: its place, theirs, their ids, the rows' ids and labels, and the inner products to 4 places."""
    for r in range(b.num_rows):
        (ids, labels, vectors), (q_ids, _, asked) = _block(b, r, "own"), _block(b, r, "asked")
        for at in range(0, len(q_ids), STRIP):
            yield r, slice(at, at + STRIP), q_ids[at : at + STRIP], ids, labels, np.round(asked[at : at + STRIP] @ vectors.T, 4)


def _long(q: np.ndarray, ids: np.ndarray, labels: pa.Array, **scores: np.ndarray) -> pa.RecordBatch:
    """A row for each query and row."""
    own = np.tile(np.arange(len(ids)), len(q))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(q, len(ids))), pa.array(ids[own]), labels.take(pa.array(own)), *[pa.array(x.ravel()) for x in scores.values()]], names=["query_id", "vec_id", "label", *scores])


def scores_batch(rows: DataFrame, queries: DataFrame, same_label: bool = False) -> DataFrame:
    """query_id, vec_id, label, sim: the inner product, to 4 places, of every query with every row, itself among them.

    Both sides are cut into blocks by their number of rows; a pair of blocks is one matrix product. With same_label, only
    rows of the query's label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, q, ids, labels, sims in _strips(b):
                yield _long(q, ids, labels, sim=sims)

    both = _met(_packed(rows, "own", ROWS, same_label), _packed(queries, "asked", BLOCK, same_label), same_label)
    return both.mapInArrow(run, "query_id long, vec_id long, label int, sim double")


def windowed_scores(rows: DataFrame, queries: DataFrame, reach: int) -> DataFrame:
    """scores_batch() with `around`: the mean score of the rows of the same label at most `reach` places away, in order of id.

    A block is a range of a label's places with `reach` rows beyond either end, so windows are formed where scores are and no score is shuffled.
    """
    at = placed(rows.select(*_numbers(rows)), "label", "vec_id")
    to = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - reach) / ROWS)), F.floor((F.col("place") + reach) / ROWS)))
    each = at.withColumn("_range", to).withColumn("mine", F.floor(F.col("place") / ROWS) == F.col("_range"))
    own = each.groupBy("label", "_range").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "label", "mine", "e"))).alias("m")).select(*_gathered("own", "mine"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, _, q, ids, labels, sims in _strips(b):
                n, total = len(ids), np.zeros_like(sims)
                count = np.zeros(n)
                for k in range(-min(reach, n - 1), min(reach, n - 1) + 1):  # in order, as a window adds
                    here, there = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
                    total[:, here] += sims[:, there]
                    count[here] += 1
                mine = np.flatnonzero(b.column("own_mine")[r].values.to_numpy(zero_copy_only=False))
                yield _long(q, ids[mine], labels.take(pa.array(mine)), sim=sims[:, mine], around=(total / count)[:, mine])

    return _met(own, _packed(queries, "asked", BLOCK)).mapInArrow(run, "query_id long, vec_id long, label int, sim double, around double")


def softmax_scores(rows: DataFrame, queries: DataFrame, heat: float) -> DataFrame:
    """query_id, vec_id, label, p: exp(sim / heat) as a share of the query's sum over the row's label.

    Blocks give sums first; a block of queries then carries its sums, a few a label, to the second product, so no score is shuffled.
    """
    sums = label_sums(rows, queries, heat).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("label", "total"))).alias("s"))
    known = queries.join(sums, queries["vec_id"] == sums["query_id"]).drop("query_id").withColumn("of", F.col("s.label")).withColumn("totals", F.col("s.total")).drop("s")
    asked = _packed(known, "asked", BLOCK, False, "of", "totals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, at, q, ids, labels, sims in _strips(b):
                of = labels.fill_null(NO_LABEL).to_numpy()
                total = np.empty_like(sims)
                for i, (names, sums) in enumerate(zip(b.column("asked_of")[r].values[at], b.column("asked_totals")[r].values[at])):
                    names = names.values.fill_null(NO_LABEL).to_numpy()
                    order = np.argsort(names)
                    total[i] = sums.values.to_numpy()[order[np.searchsorted(names[order], of)]]
                yield _long(q, ids, labels, p=np.exp(sims / heat) / (total + 1e-8))

    return _met(_packed(rows, "own", ROWS), asked).mapInArrow(run, "query_id long, vec_id long, label int, p double")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best scores, of equal ones those of the smaller ids; only what reaches the k-th best is sorted."""
    if k >= scores.shape[1]:
        return np.lexsort([np.broadcast_to(ids, scores.shape), -scores])
    least = np.partition(scores, -k, axis=1)[:, -k]
    out = np.empty((len(scores), k), dtype=int)
    for i, row in enumerate(scores):
        near = np.flatnonzero(row >= least[i])
        out[i] = near[np.lexsort([ids[near], -row[near]])[:k]]
    return out


def topk_batch(rows: DataFrame, queries: DataFrame, k: int, same_label: bool = False) -> DataFrame:
    """query_id, vec_id, label, score, rank of each query's k best rows, itself left out; with same_label, of its own label.

    Queries are gathered into blocks of about BLOCK vectors, rows into batches of about ROWS, however many there are; every
    batch meets every block once, in one matrix product that gives at most k rows a query. A window over these few
    candidates ends it. Scores are rounded to 4 places before ranking, ties go to the smaller id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, q, ids, labels, scores in _strips(b):
                scores[q[:, None] == ids[None, :]] = -np.inf
                best = _best(scores, ids, k)
                top = np.take_along_axis(scores, best, 1).ravel()
                at = np.flatnonzero(np.isfinite(top))
                best_at = best.ravel()[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, best.shape[1])[at]), pa.array(ids[best_at]), labels.take(pa.array(best_at)), pa.array(top[at])], names=["query_id", "vec_id", "label", "score"])

    both = _met(_packed(rows, "own", ROWS, same_label), _packed(queries, "asked", BLOCK, same_label), same_label)
    cand = both.mapInArrow(run, "query_id long, vec_id long, label int, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cand.withColumn("rank", rank).where(F.col("rank") <= k)


#: Stands for a null label where labels are numbers of an array.
NO_LABEL = -(2**31)


def label_sums(rows: DataFrame, queries: DataFrame, heat: float | None = None) -> DataFrame:
    """query_id, label, total, n: the sum of each query's inner products, to 4 places, with the rows of each label, and their number; with heat, of exp(product / heat).

    Blocks of both sides meet in one matrix product that gives a row for each query and label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, q, _, labels, sims in _strips(b):
                names, at = np.unique(labels.fill_null(NO_LABEL).to_numpy(), return_inverse=True)
                total = (sims if heat is None else np.exp(sims / heat)) @ (at[:, None] == np.arange(len(names)))
                own = pa.array(np.tile(names, len(q)), mask=np.tile(names == NO_LABEL, len(q)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, len(names))), own, pa.array(total.ravel()), pa.array(np.tile(np.bincount(at), len(q)))], names=["query_id", "label", "total", "n"])

    each = _met(_packed(rows, "own", ROWS), _packed(queries, "asked", BLOCK)).mapInArrow(run, "query_id long, label int, total double, n long")
    return each.groupBy("query_id", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def scene_means(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """label_sums() of the rows that have a label."""
    return label_sums(rows.where("label IS NOT NULL"), queries)


def nearest_within(rows: DataFrame, group: str) -> DataFrame:
    """vec_id, nearest, score: of each row the row of the same group with the largest inner product, itself left out.

    A group is cut into blocks of about ROWS rows. A pair of its blocks meets once, in products of some rows at a time that
    give one row per row of either block, so neither a large group nor its pairs are held in one task.
    """
    rows = rows.select(F.col(group).alias("_g"), "vec_id", F.lit(0).alias("label"), "embedding")
    sized = rows.groupBy("_g").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_blocks"))
    dealt = rows.join(sized, "_g").select("_g", "_blocks", *_numbers(rows), F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int").alias("_side"))
    packed = dealt.groupBy("_g", "_side", "_blocks").agg(F.collect_list(F.struct("vec_id", "label", "e")).alias("m"))
    own = packed.select("_g", F.col("_side").alias("_x"), F.explode(F.sequence("_side", F.col("_blocks") - 1)).alias("_y"), *_gathered("own"))
    asked = packed.select("_g", F.explode(F.sequence(F.lit(0), "_side")).alias("_x"), F.col("_side").alias("_y"), *_gathered("asked"))
    both = own.join(asked, ["_g", "_x", "_y"]).select("own_ids", "own_labels", "own_vectors", "asked_ids", "asked_labels", "asked_vectors", (F.col("_x") == F.col("_y")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                same = b.column("same")[r].as_py()
                (x, _, u), (y, _, v) = _block(b, r, "own"), _block(b, r, "asked")
                (x, u), (y, v) = ((ids[order], vectors[order]) for ids, vectors in ((x, u), (y, v)) for order in (np.argsort(ids),))  # the first best is that of the smallest id
                top, first = np.full(len(y), -np.inf), np.zeros(len(y), np.int64)
                for at in range(0, len(x), BLOCK):
                    scores = np.round(u[at : at + BLOCK] @ v.T, 4)
                    scores[np.isnan(scores)] = -np.inf
                    if same:
                        scores[x[at : at + BLOCK, None] == y[None, :]] = -np.inf
                    best = scores.argmax(1)
                    yield _near(x[at : at + BLOCK], y[best], scores[np.arange(len(best)), best])
                    if not same:
                        over = scores.argmax(0)
                        score = scores[over, np.arange(len(y))]
                        better = score > top
                        top[better], first[better] = score[better], x[at + over[better]]
                if not same:
                    yield _near(y, first, top)

    cand = both.mapInArrow(run, "vec_id long, nearest long, score double")
    best = cand.groupBy("vec_id").agg(F.max_by(F.struct("nearest", "score"), F.struct(F.col("score"), -F.col("nearest"))).alias("b"))
    return best.select("vec_id", "b.nearest", "b.score")


def _near(ids: np.ndarray, nearest: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    at = np.isfinite(score)
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(nearest[at]), pa.array(score[at])], names=["vec_id", "nearest", "score"])
