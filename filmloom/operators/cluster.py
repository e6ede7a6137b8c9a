"""Density clustering of vectors, and the components of an edge table that it needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions.vectors import doubles, norm, scaled
from filmloom.scratch import written

#: Vectors that are compared at a time, and of a block at least, about; bits of the code by which a group is dealt to blocks.
BLOCK, BITS = 512, 12
#: A group has about so many blocks, and twice as many at most, until they would be larger than LARGEST.
SHARE, LARGEST = 16, 1 << 15


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes of edges (a, b: longs): the smallest node that edges lead to, its own root if it is that.

    Each round points every node at the smallest node known to it and to its neighbours, and then twice at what that one
    points at. Rounds end when no pointer moves. Minima are taken before a shuffle; nothing is on the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    at = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "roots")
    while True:
        there = at.select(F.col("node").alias("b"), F.col("root").alias("near"))
        seen = both.join(there, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        # a root hears of the smallest root that any node pointing at it sees
        new = at.join(seen, "node").withColumn("low", F.least("root", "near"))
        told = new.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        step = written(new.join(told, "node", "left").select("node", F.col("root").alias("was"), F.least("low", F.coalesce("told", "low")).alias("root")), "step")
        for _ in range(2):
            jump = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = written(step.join(jump, "root").select("node", "was", F.col("further").alias("root")), "jump", step)
        moved = not step.where("root <> was").isEmpty()
        at = written(step.select("node", "root"), "roots", at, step)
        if not moved:
            return at


def _planes(width: int) -> np.ndarray:
    return np.random.default_rng(width).normal(size=(BITS, width))


def _codes(x: np.ndarray) -> np.ndarray:
    """Of each row, the sides of planes on which it lies."""
    return (x @ _planes(x.shape[1]).T > 0) @ (1 << np.arange(BITS - 1, -1, -1))


def _blocks(points: DataFrame, group: str) -> DataFrame:
    """group, width, block, ids, vectors (one after another): points (_id, u) that lie near each other, BLOCK or a SHARE-th of the group at a time.

    A group is dealt by the first bits of its vectors' codes, as many as make blocks of that size; codes with more rows are
    split by hash. As a large group's blocks grow with it, a vector meets about as many blocks in large groups as in small ones.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(2)
            sizes = np.diff(u.offsets.to_numpy())
            code = np.zeros(len(u), np.int64)
            for d in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == d)
                code[at] = _codes(u.take(pa.array(at)).flatten().to_numpy().reshape(-1, d))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=["_g", "_id", "u", "code"])

    kind = points.schema[group].dataType.simpleString()
    rows = points.select(F.col(group).alias("_g"), "_id", "u").mapInArrow(coded, f"_g {kind}, _id long, u array<double>, code long").withColumn("width", F.size("u"))
    each = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST), F.ceil(F.count("*") / SHARE)))
    size = rows.groupBy("_g", "width").agg(F.count("*").alias("_n"), each.alias("each"))
    size = size.select("_g", "width", "each", F.greatest(F.lit(0.0), F.least(F.lit(float(BITS)), F.ceil(F.log2(F.col("_n") / F.col("each"))).cast("double"))).alias("bits"))
    rows = rows.join(size, ["_g", "width"]).withColumn("cell", F.floor(F.col("code") / F.pow(F.lit(2.0), BITS - F.col("bits"))))
    full = rows.groupBy("_g", "width", "cell").agg(F.ceil(F.count("*") / F.first("each")).alias("parts"))
    rows = rows.join(full, ["_g", "width", "cell"]).withColumn("part", F.pmod(F.xxhash64("_id"), F.col("parts")))
    packed = rows.groupBy("_g", "width", "cell", "part").agg(F.collect_list(F.struct("_id", "u")).alias("m"))
    packed = packed.withColumn("block", F.concat_ws(":", "width", "cell", "part")).select("_g", "width", "block", F.col("m._id").alias("ids"), F.flatten("m.u").alias("vectors"))
    return packed


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of their vectors' codes, with their mean and the largest distance from it."""
    for b in batches:
        for r in range(b.num_rows):
            x = np.array(b.column(4)[r].values).reshape(-1, b.column(1)[r].as_py())
            order = np.argsort(_codes(x), kind="stable")
            centre, radius = _ball(x)
            own = [pa.array([v], pa.list_(t)) for v, t in ((np.array(b.column(3)[r].values)[order], pa.int64()), (x[order].ravel(), pa.float64()), (centre, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.slice(r, 1).columns[:3], *own, pa.array([radius])], names=["_g", "width", "block", "ids", "vectors", "centre", "radius"])


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean of rows and the largest distance from it."""
    return x.mean(0), float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).max())) + 1e-9


def _tiles(x: np.ndarray, y: np.ndarray, same: bool, eps: float, tile: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Slices of x and y, tile rows at most, that may lie within eps, and which pairs of their rows do. same: x is y, of which each two slices meet once."""
    cut = lambda m: [(slice(i, i + tile), *_ball(m[i : i + tile])) for i in range(0, len(m), tile)]
    across = cut(y)
    for i, (p, c, r) in enumerate(cut(x)):
        for j, (q, d, t) in enumerate(across):
            if (not same or i <= j) and np.sqrt(((c - d) ** 2).sum()) <= r + t + eps:
                hit = x[p] @ y[q].T >= 1 - eps * eps / 2
                if same and i == j:
                    np.fill_diagonal(hit, True)
                yield p, q, hit


def _block_pairs(blocks: DataFrame, eps: float, *more: str) -> DataFrame:
    """Pairs of blocks of a group whose points may lie within eps, each once; a block is y in about half of its pairs."""
    light = blocks.select("_g", "width", "block", "centre", "radius")
    x = light.select("_g", "width", F.col("block").alias("bx"), F.col("centre").alias("cx"), F.col("radius").alias("rx"))
    y = light.select("_g", "width", F.col("block").alias("by"), F.col("centre").alias("cy"), F.col("radius").alias("ry"))
    turn = F.pmod(F.xxhash64(F.least("bx", "by"), F.greatest("bx", "by")), F.lit(2)) == 0
    once = (F.col("bx") == F.col("by")) | ((F.col("bx") < F.col("by")) & turn) | ((F.col("bx") > F.col("by")) & ~turn)
    far = norm(F.zip_with("cx", "cy", lambda a, b: a - b))
    near = x.join(y, (x["_g"] == y["_g"]) & (x["width"] == y["width"])).where(once & (far <= F.col("rx") + F.col("ry") + eps)).select(x["_g"].alias("_g"), x["width"].alias("width"), "bx", "by")
    side = lambda s: blocks.select("_g", F.col("block").alias(f"b{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "vectors", *more)])
    return near.join(side("x"), ["_g", "bx"]).join(side("y"), ["_g", "by"])


def dbscan(rows: DataFrame, id_col: str, vec_col: str, group: str, eps: float, least: int) -> DataFrame:
    """id_col, group, cluster, is_core: density clusters of a group's vectors, brought to length one.

    A vector is a core one if `least` of its group, itself included, lie within eps of it. Core ones within eps of each
    other share a cluster; others within eps of a core one join the first such cluster; the rest have cluster -1. A group's
    clusters are numbered from 0 by their smallest core id. Ids are longs that occur once. Vectors that are null, empty,
    zero or of another length are near nothing; rows of a null group likewise.

    Blocks of a group meet only where their centres lie near enough. A pair of blocks gives counts, then a spanning forest
    of its core vectors and one core vector of each tree near any other: never its pairs.
    """
    v = doubles(F.col(vec_col))
    long = F.coalesce(norm(v), F.lit(0.0))
    points = rows.where(F.col(group).isNotNull() & (long > 0)).select(F.col(id_col).cast("long").alias("_id"), F.col(group), scaled(v, 1.0 / long).alias("u"))
    kind = rows.schema[group].dataType.simpleString()
    shape = f"_g {kind}, width int, block string, ids array<long>, vectors array<double>"
    blocks = written(_blocks(points, group).select("_g", "width", "block", "ids", "vectors").mapInArrow(_centred, f"{shape}, centre array<double>, radius double"), "blocks")
    tile = BLOCK

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Of each pair of blocks: its row, the sorted ids of both, the places of x's and y's ids among them, and its tiles."""
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: np.array(b.column(b.schema.get_field_index(c))[r].values)
                x, y, same = get("ids_x"), get("ids_y"), bool(b.column(b.schema.get_field_index("same"))[r].as_py())
                ids = np.unique(np.concatenate([x, y]))
                near = _tiles(get("vectors_x").reshape(len(x), -1), get("vectors_y").reshape(len(y), -1), same, eps, tile)
                yield get, ids, np.searchsorted(ids, x), np.searchsorted(ids, y), ((p, q, same and p == q, hit) for p, q, hit in near)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x, y, near in pairs(batches):
            n = np.zeros(len(ids), np.int64)
            for p, q, square, hit in near:
                n[x[p]] += hit.sum(1)
                if not square:
                    n[y[q]] += hit.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["_id", "n"])

    same = (F.col("bx") == F.col("by")).alias("same")
    counted = _block_pairs(blocks, eps).select("ids_x", "vectors_x", "ids_y", "vectors_y", same).mapInArrow(count, "_id long, n long")
    cores = written(counted.groupBy("_id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("_id"), "cores")
    home = blocks.select("_g", "block", F.explode("ids").alias("_id")).join(cores, "_id").groupBy("_g", "block").agg(F.collect_list("_id").alias("cores"))
    marked = blocks.join(home, ["_g", "block"], "left").withColumn("cores", F.coalesce("cores", F.array().cast("array<long>")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, ids, x, y, near in pairs(batches):
            core = np.isin(ids, np.concatenate([get("cores_x"), get("cores_y")]))
            up, edge = np.arange(len(ids)), [np.zeros((2, 0), np.int64)]
            for p, q, _, hit in near:
                a, c = x[p], y[q]
                _join(up, a, c, hit & core[a][:, None] & core[c])
                for m, own, other in ((hit & ~core[a][:, None] & core[c], a, c), ((hit & core[a][:, None] & ~core[c]).T, c, a)):
                    i, j = np.nonzero(m)
                    edge.append(np.unique(np.stack([own[i], up[other[j]]]), axis=1))
            down = np.flatnonzero(up != np.arange(len(ids)))
            own, other = np.concatenate(edge, axis=1)
            out = np.unique(np.stack([own, up[other]]), axis=1)
            for i, j, is_core in ((down, up[down], True), (*out, False)):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array([is_core] * len(i))], names=["a", "b", "core"])

    links = _block_pairs(marked, eps, "cores").select("ids_x", "vectors_x", "ids_y", "vectors_y", "cores_x", "cores_y", same)
    links = written(links.mapInArrow(link, "a long, b long, core boolean"), "links")
    roots = written(components(links.where("core").select("a", "b").union(cores.select(F.col("_id").alias("a"), F.col("_id").alias("b")))), "components", cores)
    first = points.select("_id", group).join(roots.select(F.col("root").alias("_id")).distinct(), "_id")
    number = first.withColumn("cluster", (F.row_number().over(Window.partitionBy(group).orderBy("_id")) - 1).cast("int")).select(F.col("_id").alias("root"), "cluster")
    core = roots.join(number, "root").select(F.col("node").alias("_id"), "cluster", F.lit(True).alias("is_core"))
    border = links.where("NOT core").join(core.select(F.col("_id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("_id")).agg(F.min("cluster").alias("cluster"), F.lit(False).alias("is_core"))
    known = written(core.unionByName(border), "clusters", blocks, links, roots)
    out = rows.select(F.col(id_col), F.col(group), F.col(id_col).cast("long").alias("_id")).join(known, "_id", "left")
    return out.select(id_col, group, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def _join(up: np.ndarray, x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> None:
    """Join the trees of the nodes x and y where hit is true. up: each node's root, the smallest of its tree, before and after."""
    i, j = np.nonzero(hit & (up[x][:, None] != up[y]))
    if not len(i):
        return

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = int(up[k])
        return k

    for p, q in np.unique(np.stack([up[x[i]], up[y[j]]]), axis=1).T.tolist():
        p, q = root(p), root(q)
        up[max(p, q)] = min(p, q)
    while (up[up] != up).any():
        up[:] = up[up]
