"""Near-duplicate vectors by NN-descent.

Vectors of a label get lists of near neighbours: first from blocks of a few sorted orders of random hyperplane codes, then
by rounds of a local join, in which all neighbours of a vector, and those it is a neighbour of, meet there and are
offered to each other. Lists work on vectors of one byte a dimension; what they hold near the threshold is compared in
double precision at the end. A list that holds near vectors alone is saturated: it grows twofold. When rounds find nothing
new, a sample is compared with all vectors of its labels; too low a recall starts from further orders with longer lists.

Copies and dense groups would saturate every list up to the group's size. Equal vectors are therefore one class with a
number of rows, and where a block holds many classes within half the threshold's angle of one of them, these become a ball:
any two of its members are linked, which needs no comparison and no pair. Balls have lists like vectors; pairs of balls that
come near enough have their members compared block by block, and only sums of links leave such a comparison.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop, materialise, quoted, read_table, shuffle_partitions
from ._components import components
from ._vectors import is_finite, matrix

#: Neighbours of a list at first, orders of codes, rows of a block of an order, bits of a code.
K, ORDERS, BLOCK, BITS = 12, 4, 64, 62
#: Rows of a block in which balls are sought, classes that make a ball, members of a ball that are compared at a time.
DENSE_BLOCK, DENSE, MEMBERS = 256, 32, 256
#: What lists may be wrong by, as their vectors are rounded; share of new near neighbours at which rounds end.
MARGIN, SETTLED = 0.02, 0.001
#: Vectors of an audit, recall that it must find, and times that lists are made longer for it.
AUDIT, RECALL, TRIES = 2048, 0.99, 4


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; no row is zero. Scaled first, as squares of small entries would vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_width(col: pa.ListArray):
    """(places, unit vectors) of the lists of each length."""
    sizes = np.diff(col.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, unit(matrix(col.take(pa.array(at)), int(d)).astype(float))


def _codes(u: np.ndarray, order: int) -> np.ndarray:
    """The sides of random planes on which vectors lie, the first plane in the highest bit."""
    planes = np.random.default_rng([order, u.shape[1]]).normal(size=(u.shape[1], BITS))
    return (u @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _batch(schema: dict[str, pa.DataType], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.values())], names=list(schema))


def _ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{n} {names[t]}" for n, t in schema.items())


def _sorted_blocks(batches, key: list[str], size: int):
    """(batch, places) of blocks of at most size rows that follow each other and agree in key."""
    for b in batches:
        new = np.zeros(b.num_rows, bool)
        for k in key:
            x = b.column(b.schema.get_field_index(k)).dictionary_encode().indices.to_numpy()
            new[1:] |= x[1:] != x[:-1]
        edges = [0, *np.flatnonzero(new), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            for at in range(lo, hi, size):
                yield b, np.arange(at, min(at + size, hi))


class Search:
    """The steps for one threshold; angles in radians."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.angle = math.acos(threshold)
        self.half = self.angle / 2 - 1e-6

    # Balls

    def moves(self, centres: DataFrame, order: int) -> DataFrame:
        """node, centre, radius, of centres that become members of another one, and of these themselves, in one order of codes."""
        coded, out = {"node": pa.int64(), "code": pa.int64()}, {"node": pa.int64(), "centre": pa.int64(), "radius": pa.float64()}

        def code(batches):
            for b in batches:
                for at, u in _by_width(b.column(1)):
                    yield _batch(coded, b.column(0).take(pa.array(at)), _codes(u, order))

        def gather(batches):
            for b, at in _sorted_blocks(batches, ["space"], DENSE_BLOCK):
                part = b.take(pa.array(at))
                node, size, radius = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("node", "size", "radius"))
                if size.sum() < DENSE:
                    continue
                v = part.column(part.schema.get_field_index("v"))
                u = unit(matrix(v, len(v[0])).astype(float))
                far = np.arccos(np.clip(u @ u.T, -1, 1)) + radius  # from a row's vector to all that a column's ball may hold
                np.fill_diagonal(far, radius)
                near, free = far <= self.half, np.ones(len(node), bool)
                while True:
                    held = (near & free) @ np.where(free, size, 0)
                    i = int(np.where(free, held, -1).argmax())
                    own = near[i] & free
                    if not free[i] or held[i] < DENSE or own.sum() < 2:
                        break
                    yield _batch(out, node[own], np.full(own.sum(), node[i]), np.full(own.sum(), far[i][own].max()))
                    free &= ~own

        codes = centres.select("node", "v").mapInArrow(code, _ddl(coded))
        rows = centres.join(codes, "node").repartitionByRange(shuffle_partitions(centres.sparkSession), "space", "code", "node").sortWithinPartitions("space", "code", "node")
        return rows.select("space", "node", "size", "radius", "v").mapInArrow(gather, _ddl(out))

    def balls(self, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, centre of each class; node, space, v, radius, size of each centre). Passes go on while balls still join."""
        member = classes.select("node", F.col("node").alias("centre"))
        centres = classes.select("node", "space", "v", F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("size"))
        made: tuple[DataFrame, ...] = ()
        for order in range(100, 108):
            moved = materialise(self.moves(centres, order), "moves")
            if moved.isEmpty():
                drop(moved)
                break
            to = moved.select(F.col("node").alias("centre"), F.col("centre").alias("_to"))
            member = materialise(member.join(to, "centre", "left").select("node", F.coalesce("_to", "centre").alias("centre")), "member", made[:1])
            held = centres.select("node", "size").join(moved.select("node", "centre", F.col("radius").alias("_r")), "node").groupBy(F.col("centre").alias("node")).agg(F.sum("size").alias("_n"), F.max("_r").alias("_r"))
            gone = moved.where("node <> centre").select("node")
            left = centres.join(gone, "node", "left_anti").join(held, "node", "left")
            centres = materialise(left.select("node", "space", "v", F.coalesce("_r", "radius").alias("radius"), F.coalesce("_n", "size").alias("size")), "centres", (*made[1:], moved))
            made = (member, centres)
        return member, centres

    # Lists: rows a, b, sim, near (whether members of a and b may be linked), fresh (new), k (length of a's list), bar (what a newcomer must exceed)

    def bound(self, radii: np.ndarray) -> np.ndarray:
        """Least similarity of two centres whose balls, of these radii together, may hold linked members."""
        return np.cos(np.minimum(self.angle + radii, math.pi)) - MARGIN

    EDGE = {"a": pa.int64(), "b": pa.int64(), "sim": pa.float64(), "near": pa.bool_(), "k": pa.int32()}

    def first_lists(self, items: DataFrame, orders: range, k: int) -> DataFrame:
        """The best k of each block's rows for each of them, in all orders."""
        coded = {"order": pa.int32(), "space": pa.string(), "code": pa.int64(), "node": pa.int64(), "q": pa.binary(), "scale": pa.float64(), "radius": pa.float64()}

        def code(batches):
            for b in batches:
                q = b.column(2).to_pylist()
                sizes = np.array([len(x) for x in q])
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    u = np.frombuffer(b"".join(q[i] for i in at), np.int8).reshape(-1, d).astype(np.float32)
                    rest = [b.column(i).take(pa.array(at)) for i in (1, 0, 2, 3, 4)]
                    for o in orders:
                        yield _batch(coded, np.full(len(at), o), rest[0], _codes(u, o), *rest[1:])

        def meet(batches):
            for b, at in _sorted_blocks(batches, ["order", "space"], BLOCK):
                if len(at) < 2:
                    continue
                part = b.take(pa.array(at))
                node, scale, radius = (part.column(i).to_numpy() for i in (2, 4, 5))
                u = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int8).reshape(len(at), -1).astype(np.float32)
                sim = (u @ u.T).astype(float) * scale[:, None] * scale
                near = sim >= self.bound(radius[:, None] + radius)
                rank = sim + 4 * near
                np.fill_diagonal(rank, -np.inf)
                best = np.argsort(-rank, 1)[:, : min(k, len(at) - 1)]
                rows = np.repeat(np.arange(len(at)), best.shape[1])
                cols = best.ravel()
                yield _batch(self.EDGE, node[rows], node[cols], sim[rows, cols], near[rows, cols], np.full(len(rows), k))

        rows = items.select("node", "space", "q", "scale", "radius").mapInArrow(code, _ddl(coded))
        rows = rows.repartitionByRange(shuffle_partitions(items.sparkSession), "order", "space", "code", "node").sortWithinPartitions("order", "space", "code", "node")
        return rows.select("order", "space", "node", "q", "scale", "radius").mapInArrow(meet, _ddl(self.EDGE))

    @staticmethod
    def lists(edges: DataFrame, longest: int) -> DataFrame:
        """Of edges, the best of each a as its list: near ones first. A full list of near ones grows twofold."""
        same = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.bool_or("near").alias("near"), F.max("k").alias("k"), F.bool_and("fresh").alias("fresh"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("near"), F.desc("sim"), "b"))
        own = Window.partitionBy("a")
        best = same.withColumn("_rank", rank).where(F.col("_rank") <= longest).withColumn("_k", F.max("k").over(own)).where("_rank <= _k")
        best = best.withColumn("_full", F.count("*").over(own) >= F.col("_k")).withColumn("_grows", F.col("_full") & F.bool_and("near").over(own))
        bar = F.when(F.col("_full") & ~F.col("_grows"), F.min("sim").over(own)).otherwise(-2.0)
        return best.select("a", "b", "sim", "near", "fresh", F.when(F.col("_grows"), F.col("_k") * 2).otherwise(F.col("_k")).alias("k"), bar.alias("bar"), F.col("_grows").alias("grows"))

    def local_join(self, items: DataFrame, lists: DataFrame) -> DataFrame:
        """What the neighbours of each vector, one of two at least a new one, are to each other, if a list may take it."""
        back = lists.select(F.col("b").alias("v"), F.col("a").alias("u"), "fresh")
        turn = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("v", "u")))
        back = back.withColumn("_turn", turn).where(F.col("_turn") <= K).drop("_turn")
        both = lists.select(F.col("a").alias("v"), F.col("b").alias("u"), "fresh").union(back).groupBy("v", "u").agg(F.bool_or("fresh").alias("fresh"))
        state = lists.groupBy(F.col("a").alias("u")).agg(F.max("k").alias("k"), F.max("bar").alias("bar"))
        known = items.select(F.col("node").alias("u"), "q", "scale", "radius").join(state, "u", "left")
        known = known.select("u", "q", "scale", "radius", F.coalesce("k", F.lit(K)).alias("k"), F.coalesce("bar", F.lit(-2.0)).alias("bar"))
        met = both.join(known, "u").groupBy("v").agg(F.collect_list(F.struct("u", "fresh", "q", "scale", "radius", "k", "bar")).alias("all"))

        def meet(batches):
            for batch in batches:
                col = batch.column(0)
                ends, flat = col.offsets.to_numpy() - col.offsets[0].as_py(), col.flatten()
                u, fresh, scale, radius, k, bar = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5, 6))
                q, out, size = flat.field(2).to_pylist(), [], 0
                for lo, hi in zip(ends, ends[1:]):
                    if hi - lo < 2 or not fresh[lo:hi].any():
                        continue
                    vec = np.frombuffer(b"".join(q[lo:hi]), np.int8).reshape(hi - lo, -1).astype(np.float32)
                    sim = (vec @ vec.T) * scale[lo:hi, None].astype(np.float32) * scale[lo:hi].astype(np.float32)
                    near = sim >= self.bound(radius[lo:hi, None] + radius[lo:hi])
                    use = (near | (sim > bar[lo:hi, None])) & (fresh[lo:hi, None] | fresh[lo:hi])
                    np.fill_diagonal(use, False)
                    i, j = np.nonzero(use)
                    out.append((u[lo + i], u[lo + j], sim[i, j].astype(float), near[i, j], k[lo + i]))
                    size += len(i)
                    if size > 1 << 18:
                        yield _batch(self.EDGE, *map(np.concatenate, zip(*out)))
                        out, size = [], 0
                if out:
                    yield _batch(self.EDGE, *map(np.concatenate, zip(*out)))

        return met.select("all").mapInArrow(meet, _ddl(self.EDGE)).withColumn("fresh", F.lit(True))

    def audited(self, items: DataFrame, lists: DataFrame) -> tuple[float, DataFrame]:
        """(recall of near neighbours in the lists of AUDIT vectors, against all vectors of their spaces; the pairs that were missed, as edges)."""
        asked = items.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "space", "q", "scale", "radius").collect()
        spaces: dict[str, list] = {}
        for r in asked:
            spaces.setdefault(r["space"], []).append(r)
        vecs = {s: (np.array([r["node"] for r in rs]), np.frombuffer(b"".join(bytes(r["q"]) for r in rs), np.int8).reshape(len(rs), -1).astype(np.float32) * np.array([[r["scale"]] for r in rs]), np.array([r["radius"] for r in rs])) for s, rs in spaces.items()}

        def compare(batches):
            for b in batches:
                names = b.column(1).dictionary_encode()
                for code, s in enumerate(names.dictionary.to_pylist()):
                    if s not in vecs:
                        continue
                    at = pa.array(np.flatnonzero(names.indices.to_numpy() == code))
                    node, scale, radius = (b.column(i).take(at).to_numpy() for i in (0, 3, 4))
                    u = np.frombuffer(b"".join(b.column(2).take(at).to_pylist()), np.int8).reshape(len(node), -1).astype(np.float32) * scale[:, None]
                    for lo in range(0, len(node), 4096):
                        sim = vecs[s][1] @ u[lo : lo + 4096].T
                        i, j = np.nonzero((sim >= self.bound(vecs[s][2][:, None] + radius[lo : lo + 4096]) + MARGIN) & (vecs[s][0][:, None] != node[lo : lo + 4096]))
                        yield _batch(self.EDGE, vecs[s][0][i], node[lo + j], sim[i, j], np.ones(len(i), bool), np.full(len(i), K))

        true = materialise(items.select("node", "space", "q", "scale", "radius").mapInArrow(compare, _ddl(self.EDGE)), "audit")
        n = true.count()
        missed = materialise(true.join(lists.where("near").select("a", "b"), ["a", "b"], "left_anti"), "missed", (true,))
        m = missed.count()
        return (1 - m / n if n else 1.0), missed.withColumn("fresh", F.lit(True))

    def near_pairs(self, centres: DataFrame) -> DataFrame:
        """a, b (a < b): pairs of centres whose members may be linked."""
        packed = {"node": pa.int64(), "space": pa.string(), "q": pa.binary(), "scale": pa.float64(), "radius": pa.float64()}

        def pack(batches):
            for b in batches:
                for at, u in _by_width(b.column(2)):
                    scale = np.abs(u).max(1) / 127
                    q = np.rint(u / scale[:, None]).astype(np.int8)
                    rows = pa.array(at)
                    yield _batch(packed, b.column(0).take(rows), b.column(1).take(rows), [x.tobytes() for x in q], scale, b.column(3).take(rows))

        items = materialise(centres.select("node", "space", "v", "radius").mapInArrow(pack, _ddl(packed)), "items")
        k, edges = K, self.first_lists(items, range(ORDERS), K).withColumn("fresh", F.lit(True))
        lists = materialise(self.lists(edges, k), "lists")
        for turn in range(1, TRIES + 1):
            while True:
                found = lists.select("a", "b", "sim", "near", "k", F.lit(False).alias("fresh")).union(self.local_join(items, lists))
                k = max(k, lists.agg(F.max("k")).first()[0] or K)
                lists = materialise(self.lists(found, k), "lists", (lists,))
                near, new, grown = lists.agg(F.count_if("near"), F.count_if(F.col("near") & F.col("fresh")), F.count_if("grows")).first()
                if new <= SETTLED * near and not grown:
                    break
            recall, missed = self.audited(items, lists)
            if recall >= RECALL:
                break
            k *= 2
            more = self.first_lists(items, range(ORDERS * turn, ORDERS * (turn + 1)), k).withColumn("fresh", F.lit(True)).union(missed)
            lists = materialise(self.lists(lists.select("a", "b", "sim", "near", F.greatest("k", F.lit(k)).alias("k"), "fresh").union(more), k), "lists", (lists,))
        else:
            warnings.warn(f"an audit found only {recall:.3f} of near vectors", stacklevel=2)
        return materialise(lists.where("near").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", (lists, items))

    def compared(self, members: DataFrame, pairs: DataFrame) -> DataFrame:
        """node, links, a, b of members of different balls: a member's links in a block, and the balls linked (node null)."""
        out = {"node": pa.int64(), "links": pa.int64(), "a": pa.int64(), "b": pa.int64()}
        blocks = members.withColumn("_block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / MEMBERS)))
        blocks = blocks.groupBy("centre", "_block").agg(F.collect_list(F.struct("node", "n", "v")).alias("m"))
        side = lambda name: blocks.select(F.col("centre").alias(name), F.col("m").alias(f"m{name}"))

        def compare(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    left, right = (batch.column(c)[r].values for c in (2, 3))
                    (na, ca, va), (nb, cb, vb) = (tuple(s.field(i) for i in range(3)) for s in (left, right))
                    u, w = (unit(matrix(v, len(v[0])).astype(float)) for v in (va, vb))
                    linked = u @ w.T >= self.threshold
                    if not linked.any():
                        continue
                    a, b = linked @ cb.to_numpy(), ca.to_numpy() @ linked
                    nodes, links = np.concatenate([na.to_numpy(), nb.to_numpy()]), np.concatenate([a, b])
                    yield _batch(out, nodes[links > 0], links[links > 0], pa.nulls(int((links > 0).sum()), pa.int64()), pa.nulls(int((links > 0).sum()), pa.int64()))
                    yield _batch(out, pa.nulls(1, pa.int64()), [0], [batch.column(0)[r].as_py()], [batch.column(1)[r].as_py()])

        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInArrow(compare, _ddl(out))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """id_col, n_links (other rows linked), component_id (smallest id reachable by links, itself included), kept (whether the id is that).

    Two rows are linked if their labels are equal and their cosine, in double precision, is threshold or more. Rows with a
    null label, and vectors that are null, zero, or hold null or non-finite entries, are linked with nothing, and
    vectors of different length are not linked. Rows with equal vectors are linked, and repeated rows count each. A null id
    comes after all others: a component of null ids has a null id, and its rows are kept. An empty table gives an empty
    result; other columns don't matter.
    """
    v = F.col(quoted(vec_col)).cast("array<double>")
    rows = vectors.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(label_col)).alias("label"), v.alias("v"))
    ok = F.col("label").isNotNull() & is_finite(F.col("v")) & F.exists("v", lambda c: c != 0)
    classes = rows.where(ok).groupBy("label", "v").agg(F.count("*").alias("n"), F.min("_id").alias("low"))
    space = F.concat_ws(":", F.size("v"), F.col("label").cast("string"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "label", space.alias("space"), "v", "n", "low"), "classes")
    search = Search(threshold)
    member, centres = search.balls(classes)
    pairs = search.near_pairs(centres)
    members = classes.select("node", "v", "n", "low").join(member, "node").join(centres.select(F.col("node").alias("centre"), "size"), "centre")
    near = pairs.select(F.explode(F.array("a", "b")).alias("centre")).distinct()
    found = materialise(search.compared(members.join(near, "centre", "left_semi"), pairs), "found", (pairs,))
    roots = components(found.where("node IS NULL").select("a", "b"))
    links = found.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    inner = members.groupBy("centre").agg(F.sum("n").alias("inner"))
    each = members.select("node", "centre", "low").join(inner, "centre").join(roots.select(F.col("a").alias("centre"), F.col("b").alias("root")), "centre", "left")
    each = each.join(links, "node", "left").select("node", "low", F.coalesce("root", "centre").alias("root"), (F.col("inner") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    each = materialise(each, "each", (found, roots, *(t for t in (member, centres) if hasattr(t, "_filmloom_path"))))
    smallest = each.groupBy("root").agg(F.min("low").alias("component_id"))
    known = classes.select("node", "label", "v").join(each.join(smallest, "root"), "node").select("label", "v", "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.join(known, ["label", "v"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def op13_nn_descent(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
