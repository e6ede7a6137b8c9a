"""N-gram Jaccard self-join with a count-vector R-tree.

A document's distinct word shingles are hashed into groups; the counts of its groups are a point. The overlap of two
documents is at most the sum over groups of the smaller count, and at most that sum with a box's upper corner for all
documents in the box. Two documents that link differ in at most tau shingles, tau = (100 - p) / (100 + p) of their
sizes' sum.

1. Top of the tree. Documents of one size class have their groups dealt into m > tau ranges of coordinates; a box pins a
   range to one value. Two that link agree in m - tau ranges at least, so each document needs only its tau + 1 rarest
   boxes (and those of the next class, if a partner may be there): of any two that link, one box is still common. Boxes
   that many documents fall into, through passages that they share, go first. Boxes travel as packed bytes by shard;
   boxes of one document are dropped at once. Documents with equal sets are one point throughout.
2. Each document is first verified against one partner, the smallest id of the box it shares most often; components of
   these links follow. That settles large groups of near copies in linear time.
3. In boxes that still hold several components, R-trees over count vectors are joined: nodes whose corners rule out any
   link are left, then fine count vectors bound the overlap of documents of different components. The first two rounds
   take, of the pairs that survive, a spanning forest of each unit's components (at most a pair a row): first within
   blocks of a box, then across blocks too. Sets decide. The last round takes all pairs that survive and were not
   rejected before, each once whatever boxes it shares, so no link between components is lost; they are
   many where a large group lies close to the threshold, so sets are sent to units, not to pairs.

Pairs meet their count vectors before any set is fetched. Sets, links and boxes stay in tables; the driver sees counts only.
"""
from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bucketed, drop, materialise, parts_for, quoted, read_table
from ._components import components
from ._hashing import U, mix, shard_rows, text_batches, word_hashes

GROUPS = 64
#: A count vector has at most so many coordinates, which bounds the memory of a block; the bound is looser beyond.
FINEST = 1 << 15
#: Rows of a box that are searched together.
BLOCK_ROWS = 1024
#: Pairs of units that a task holds before it passes them on.
HELD_PAIRS = 1 << 18
GROWTH = 1.5
#: Ranges for each shingle that may differ. More of them let a document leave out more of its common boxes.
SPARE = 1.25
#: Size classes fit into a box key's lowest bits.
CLASS_BITS = 6
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], U)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; with fewer words than width the whole sequence is one shingle."""
    words, counts = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    with np.errstate(over="ignore"):
        h = mix(sum((words[i : i + n] * _K[i] for i in range(width)), np.zeros(n, U)))
    out, start = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(h[start : start + c - width + 1]))
        elif c:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(words[start : start + c] * _K[:c]).sum() + U(c)], U)))
        else:
            out.append(np.zeros(0, U))
        start += c
    return out


def set_id(s: np.ndarray) -> int:
    """A 63-bit name of the set: equal sets have equal names; others with odds of pairs / 2^63."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s + U(1)).sum() + U(len(s))], U))[0] >> U(1))


@cache
def size_classes(percent: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each class: smallest and largest size, tau, number of ranges. Documents of class 0 link to equal sets only."""
    tau = lambda hi: (100 - percent) * 2 * hi // (100 + percent)
    lo, hi = [1], [1]
    while tau(hi[0] + 1) == 0:
        hi[0] += 1
    while hi[-1] < 1 << 31:  # a text has less than 2^31 bytes
        lo.append(hi[-1] + 1)
        hi.append(max(lo[-1], int(lo[-1] * GROWTH)))
    taus = [tau(h) for h in hi]
    return lo, hi, taus, [max(t + 2, int(t * SPARE) + 2) for t in taus]


def boxes(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int], int]:
    """Keys of the boxes of a set, how many of them it can do without in each of its classes, and the first class.

    At least m - tau of the m ranges agree for two that link, so tau + 1 keys will do. A range without shingles gets a
    key only if the set has so many of them that two sets could agree in nothing else; all keys are needed then.
    """
    lo, hi, taus, ranges = size_classes(percent)
    own_class = c = bisect.bisect_left(hi, len(s))
    out, spare = [], []
    while c < len(lo) and (c == own_class or 100 * len(s) >= percent * lo[c]):
        spare.append(0)
        if taus[c]:
            m = ranges[c]
            with np.errstate(over="ignore"):
                own = mix(s + U(c))
                at = (own >> U(20)) % U(m)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                value = np.add.reduceat(mix(own ^ _K[1])[order], first)
                if len(used) <= taus[c]:
                    empty = np.setdiff1d(np.arange(m, dtype=U), used)
                    used, value = np.concatenate([used, empty]), np.concatenate([value, np.zeros(len(empty), U)])
                else:
                    spare[-1] = len(used) - taus[c] - 1
                key = mix(value + (used * U(1 << 20) + U(c)) * _K[2])
                out.append(((key >> U(CLASS_BITS)) << U(CLASS_BITS)) | U(c))
        c += 1
    return np.concatenate(out) if out else np.zeros(0, U), spare, own_class


def count_vector(s: np.ndarray) -> tuple[bytes, bytes]:
    """A point: counts of GROUPS groups, and the fine counts of 4 to 8 times as many groups as shingles, up to FINEST.

    Fine counts are two rows of bits: groups with one shingle or more, groups with two or more.
    """
    groups = min(max(GROUPS, 4 << (len(s) - 1).bit_length()), FINEST)
    at = (s >> U(7)).astype(np.int64) % groups
    counts = np.bincount(at, minlength=groups)
    coarse = counts.reshape(-1, GROUPS).sum(0).astype("<u4")
    return coarse.tobytes(), np.packbits(counts > 0).tobytes() + np.packbits(counts > 1).tobytes()


class CountVectors:
    """The fine count vectors of a block, by their number of groups."""

    #: Words of bits that are compared at a time.
    CHUNK = 1 << 20

    def __init__(self, vectors: list[bytes], sizes: np.ndarray):
        self.sizes, self.words = sizes, np.array([len(v) // 16 for v in vectors])
        self.at, self.rows, self.rest = np.zeros(len(vectors), np.int64), {}, {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.at[own] = np.arange(len(own))
            self._add(w, w, np.frombuffer(b"".join(vectors[i] for i in own), U).reshape(len(own), 2, w), sizes[own])

    def _add(self, words: int, folded: int, rows: np.ndarray, sizes: np.ndarray) -> None:
        self.rows[words, folded] = rows
        self.rest[words, folded] = sizes - np.bitwise_count(rows).sum((1, 2), dtype=np.int64)

    def folded(self, words: int, to: int) -> None:
        """Make rows of words also available as counts of fewer groups."""
        if (words, to) not in self.rows:
            self.folded(words, 2 * to)
            one, two = self.rows[words, 2 * to][:, 0], self.rows[words, 2 * to][:, 1]
            a, b = one[:, :to], one[:, to:]
            own = np.flatnonzero(self.words == words)
            self._add(words, to, np.stack([a | b, (a & b) | two[:, :to] | two[:, to:]], 1), self.sizes[own])

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The most that the sets of each i and j can share: groups that both have, twice where both have two, and what is beyond."""
        out = np.zeros(len(i), np.int64)
        pair = np.minimum(self.words[i], self.words[j]), np.maximum(self.words[i], self.words[j])
        for lo, hi in np.unique(np.stack(pair, 1), axis=0).tolist():
            own = np.flatnonzero((pair[0] == lo) & (pair[1] == hi))
            swap = self.words[i[own]] == lo
            a, b = np.where(swap, i[own], j[own]), np.where(swap, j[own], i[own])
            self.folded(hi, lo)
            for k in range(0, len(own), step := max(1, self.CHUNK // (2 * lo))):
                p, q = self.at[a[k : k + step]], self.at[b[k : k + step]]
                both = np.bitwise_count(self.rows[lo, lo][p] & self.rows[hi, lo][q]).sum((1, 2), dtype=np.int64)
                out[own[k : k + step]] = both + np.minimum(self.rest[lo, lo][p], self.rest[hi, lo][q])
        return out


class CountRTree:
    """Points packed into boxes of FAN, boxes into boxes, each with its upper corner and smallest size."""

    FAN = 16
    #: Pairs of nodes that are compared at a time.
    CHUNK = 1 << 14

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        # Packed by size and then by the coordinate that varies most.
        wide = points[:, points.var(0).argmax()]
        self.order = np.lexsort([wide, sizes // max(1, int(sizes.max()) // 8)])
        self.percent, self.levels = percent, [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > self.FAN:
            p, n = self.levels[-1]
            at = np.arange(0, len(p), self.FAN)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(n, at)))

    def join(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different points that may link."""
        top = len(self.levels[-1][0])
        a, b = np.triu_indices(top)
        for depth in range(len(self.levels) - 1, -1, -1):
            p, n = self.levels[depth]
            live = (a < len(p)) & (b < len(p)) & (a <= b)
            a, b = a[live], b[live]
            ok = np.zeros(len(a), bool)
            for k in range(0, len(a), self.CHUNK):
                x, y = a[k : k + self.CHUNK], b[k : k + self.CHUNK]
                ok[k : k + self.CHUNK] = (100 + self.percent) * np.minimum(p[x], p[y]).sum(1, dtype=np.int64) >= self.percent * (n[x] + n[y])
            a, b = a[ok], b[ok]
            if depth:
                step = np.arange(self.FAN)
                x, y = a[:, None, None] * self.FAN + step[:, None], b[:, None, None] * self.FAN + step
                a, b = np.broadcast_to(x, (len(a), self.FAN, self.FAN)).ravel(), np.broadcast_to(y, (len(b), self.FAN, self.FAN)).ravel()
        a, b = a[a < b], b[a < b]
        return self.order[a], self.order[b]


def spanning(i: np.ndarray, j: np.ndarray, comp: np.ndarray) -> list[int]:
    """Positions of pairs (i, j), in their order of preference, that join components not joined by earlier ones."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, left = [], len(np.unique(comp)) - 1
    for at, (x, y) in enumerate(zip(comp[i].tolist(), comp[j].tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(at)
            left -= 1
            if not left:
                break
    return out


_DOC = "to int, doc_id {id}, n long, sid long, first int, spare array<int>, keys binary, sids binary"


def _emit(width: int, percent: int, shards: int, schema: pa.Schema):
    """A row with id, size, set's name and spare boxes of each document, and the boxes of all by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            sets = shingle_sets(texts, width)
            names = [set_id(s) for s in sets]
            once = {i: boxes(s, percent) for i, s in dict(zip(names, sets, strict=True)).items()}
            cols = [pa.array([i % shards for i in names], pa.int32()), pa.array(ids, schema.field("doc_id").type), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64())]
            cols += [pa.array([once[i][2] for i in names], pa.int32()), pa.array([once[i][1] for i in names], pa.list_(pa.int32())), *[pa.nulls(len(ids), pa.binary())] * 2]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
            flat, own = np.concatenate([k[0] for k in once.values()]), np.repeat(np.fromiter(once, np.int64, len(once)), [len(k[0]) for k in once.values()])
            rows = [{"to": s, "keys": k.tobytes(), "sids": i.tobytes()} for s, k, i in shard_rows(flat, shards, own)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _shared_boxes(schema: pa.Schema):
    """Boxes of a shard that hold two sets or more: a row (key, sid, number of sets in the box) each. Documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids = [], []
        for b in batches:
            doc = b.column("keys").is_null().to_numpy(zero_copy_only=False)
            d = b.filter(pa.array(doc))
            if d.num_rows:
                none = pa.nulls(d.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(d.column(c) for c in ("doc_id", "n", "sid", "first", "spare")), none, none], schema=schema)
            for k, s in zip(b.column("keys").filter(pa.array(~doc)).to_pylist(), b.column("sids").filter(pa.array(~doc)).to_pylist()):
                keys.append(np.frombuffer(k, np.int64))
                sids.append(np.frombuffer(s, np.int64))
        if not keys:
            return
        k, s = np.concatenate(keys), np.concatenate(sids)
        keys.clear(), sids.clear()
        order = np.lexsort([s, k])
        k, s = k[order], s[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        k, s = k[new], s[new]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(first, len(k)))
        count = np.repeat(count, count)
        k, s, count = (x[count > 1] for x in (k, s, count))
        for i in range(0, len(k), 50_000):
            part = slice(i, i + 50_000)
            cols = {"sid": pa.array(s[part]), "key": pa.array(k[part]), "sets": pa.array(count[part])}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(len(k[part]), f.type)) for f in schema], schema=schema)

    return run


def _sets(width: int):
    """Set, size and count vectors of documents (text, expected sid); others' rows with the same id fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sids, texts in text_batches(batches):
            sets = shingle_sets(texts, width)
            keep = [(i, s) for i, s in zip(sids, sets, strict=True) if set_id(s) == i]
            vectors = [count_vector(s) for _, s in keep]
            cols = [pa.array([i for i, _ in keep], pa.int64()), pa.array([len(s) for _, s in keep], pa.int64()), *(pa.array([v[k] for v in vectors], pa.binary()) for k in (0, 1)), pa.array([s.tobytes() for _, s in keep], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["sid", "n", "coarse", "fine", "hashes"])

    return run


def _may_link(percent: int):
    """Pairs (a, b, sizes na, nb, vectors va, vb) that their count vectors don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, at = np.concatenate([b.column("na").to_numpy(), b.column("nb").to_numpy()]), np.arange(b.num_rows)
                bound = CountVectors([*b.column("va").to_pylist(), *b.column("vb").to_pylist()], n).bounds(at, at + len(at))
                yield b.select(["a", "b"]).filter(pa.array((100 + percent) * bound >= percent * (n[at] + n[at + len(at)])))

    return run


def _linked(percent: int):
    """Pairs (a, b) whose sets (ha, hb) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("ha"), b.column("hb")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).append_column("ok", pa.array(ok, pa.bool_()))

    return run


def _cross_pairs(percent: int, all_pairs: bool):
    """Pairs of different components in a unit (rows sorted by it) that count vectors can't rule out: all of them or a
    spanning forest. Two that share several boxes may be in several units' pairs."""

    def search(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        comp, side, size, sid = (t[c].to_numpy() for c in ("comp", "side", "n", "sid"))
        if (comp == comp[0]).all():
            return sid[:0], sid[:0]
        coarse = np.frombuffer(b"".join(t["coarse"].to_pylist()), "<u4").reshape(len(sid), GROUPS).astype(np.int64)
        i, j = CountRTree(coarse, size, percent).join()
        ok = comp[i] != comp[j]
        if t["across"][0].as_py():
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        bound = CountVectors(t["fine"].to_pylist(), size).bounds(i, j)
        spare = (100 + percent) * bound - percent * (size[i] + size[j])
        i, j, spare = i[spare >= 0], j[spare >= 0], spare[spare >= 0]
        if not all_pairs:
            order = np.lexsort([sid[j], sid[i], -spare / (size[i] + size[j])])
            i, j = i[order], j[order]
            chosen = spanning(i, j, comp)
            i, j = i[chosen], j[chosen]
        return np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows < 2:
                return
            unit = t["unit"].to_numpy()
            edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            found: list[tuple[np.ndarray, ...]] = []
            for x, y in zip(edges, edges[1:]):
                if y - x > 1:
                    a, b = search(t.slice(x, y - x))
                    if len(a):
                        found.append((a, b, np.full(len(a), unit[x])))
                if found and (y == len(unit) or sum(len(f[0]) for f in found) > HELD_PAIRS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "unit"])
                    found = []

        for b in batches:  # a unit may go on in the next batch
            unit = b.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            if cut or (held and len(unit) and held[-1].column("unit")[-1].as_py() != unit[0]):
                yield from flush(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """A table (a, b, ok) of the pairs that count vectors don't rule out, None if there are no pairs. Sets are fetched for these alone, from tables, so that AQE can split hot ones."""
    pairs = materialise(pairs, "pairs")
    if pairs.isEmpty():
        drop(pairs)
        return None
    end = lambda x, *cols: sets.select(F.col("sid").alias(x), *[F.col(c).alias(f"{'v' if c == 'fine' else c[0]}{x}") for c in cols])
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = pairs.join(end("a", "n", "fine"), "a").join(end("b", "n", "fine"), "b").where(fit).select("a", "b", "na", "nb", "va", "vb")
    near = materialise(near.mapInArrow(_may_link(percent), "a long, b long"), "near", (pairs,))
    both = near.join(end("a", "hashes"), "a").join(end("b", "hashes"), "b").select("a", "b", "ha", "hb")
    return materialise(both.mapInArrow(_linked(percent), "a long, b long, ok boolean"), "verified", (near,))


def _linked_in_unit(percent: int):
    """Of a unit's pairs (a, b), given its sets (sid, hashes), links that join all that its links join."""

    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        sets = {i: np.frombuffer(h.as_buffer(), U) for i, h in zip(rows["sid"].to_pylist(), rows["hashes"])}
        root, out = {i: i for i in sets}, []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            if find(a) != find(b):
                x, y = sets[a], sets[b]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (len(x) + len(y) - same):
                    root[find(a)] = find(b)
                    out.append((a, b))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _verify_in_units(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A table of links (a, b) among pairs (a, b, unit). Each set goes once to each unit that needs it, not once to each pair; a unit has at most two blocks of sets."""
    ends = pairs.select(F.col("unit").alias("of"), F.col("a").alias("sid")).union(pairs.select("unit", "b")).distinct()
    rows = ends.join(sets.select("sid", "hashes"), "sid")
    links = pairs.groupBy("unit").cogroup(rows.groupBy("of")).applyInArrow(_linked_in_unit(percent), "a long, b long")
    return materialise(links, "links")


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (sid, comp) after links between sids."""
    if links.isEmpty():
        return comp
    ends = links.join(comp.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("sid").alias("b"), F.col("comp").alias("cb")), "b")
    roots = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    out = comp.join(roots, comp["comp"] == roots["a"], "left").select("sid", F.coalesce("b", "comp").alias("comp"))
    return materialise(out, "comp", (comp, roots))


def _units(live: DataFrame, comp: DataFrame, across: bool) -> tuple[DataFrame, DataFrame]:
    """Tables of the rows (key, sid, comp, side) in open boxes, and of their units (key, side, other): blocks or pairs of blocks with several components."""
    tagged = live.join(comp, "sid")
    open_ = tagged.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x < y")
    open_ = materialise(open_.select("key", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks")), "open")
    rows = tagged.join(open_, "key").select("key", "sid", "comp", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("side"))
    rows = materialise(rows, "live", (open_,))
    blocks = rows.groupBy("key", "side").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    if not across:
        return rows, materialise(blocks.where("x < y").select("key", "side", F.col("side").alias("other")), "units")
    blocks = materialise(blocks, "blocks")
    other = blocks.select("key", F.col("side").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    units = blocks.join(other, "key").where("side <= other and least(x, x2) < greatest(y, y2)").select("key", "side", "other")
    return rows, materialise(units, "units", (blocks,))


def _round(shared: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, parts: int, across: bool, all_pairs: bool) -> DataFrame | None:
    """A table of pairs (a, b) of different components that may link, or None if no unit has several components. With all_pairs it names their units too."""
    live, units = _units(shared, comp, across)
    if units.isEmpty():
        drop(live, units)
        return None
    ends = units.select("key", "side", "other", F.col("side").alias("own")).union(units.where("side < other").select("key", "side", "other", F.col("other").alias("own")))
    rows = live.select("key", "sid", "comp", F.col("side").alias("own")).join(ends, ["key", "own"])
    rows = rows.join(sets.select("sid", "n", "coarse", "fine"), "sid")
    rows = rows.select(F.xxhash64("key", "side", "other").alias("unit"), (F.col("side") < F.col("other")).alias("across"), F.col("own").alias("side"), "sid", "n", "comp", "coarse", "fine")
    pairs = rows.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_cross_pairs(percent, all_pairs), "a long, b long, unit long")
    once = pairs.groupBy("a", "b").agg(F.min("unit").alias("unit")) if all_pairs else pairs.select("a", "b").distinct()
    return materialise(once, "crossing", (live, units))


def _components(shared: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """A table sid, comp of all sets, from the boxes they share (key, sid)."""
    # One partner each: the smallest id of most of its boxes.
    low = shared.join(shared.groupBy("key").agg(F.min("sid").alias("low")), "key").where("low < sid")
    first = low.groupBy("sid", "low").agg(F.count("*").alias("c")).groupBy("sid").agg(F.max_by("low", F.struct("c", "low")).alias("low"))
    comp, tried = materialise(sets.select("sid", F.col("sid").alias("comp")), "comp"), []

    def untried(pairs: DataFrame) -> DataFrame:
        for t in tried:
            pairs = pairs.join(t.where("not ok").select("a", "b"), ["a", "b"], "left_anti")
        return pairs

    def settle(pairs: DataFrame) -> None:
        nonlocal comp
        found = _verify(untried(pairs), sets, percent)
        if found is not None:
            tried.append(found)
            comp = _merge(comp, found.where("ok"))

    settle(first.select(F.col("low").alias("a"), F.col("sid").alias("b")))
    large = not shared.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).isEmpty()
    for across in (False, True) if large else (False,):
        crossing = _round(shared, comp, sets, percent, parts, across, False)
        if crossing is not None:
            settle(crossing)
            drop(crossing)
    crossing = _round(shared, comp, sets, percent, parts, True, True)
    if crossing is not None:
        pairs = materialise(untried(crossing), "pairs", (crossing,))
        links = _verify_in_units(pairs, sets, percent)
        drop(pairs)
        comp = _merge(comp, links)
        drop(links)
    drop(*tried)
    return comp


def _rarest(boxed: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (key, sid) of boxes (key, sid, sets), without the most common ones that a set can spare. Of boxes with the same members, one will do."""
    place = Window.partitionBy("sid", "class").orderBy(F.desc("sets"), F.desc("key"))
    rows = boxed.withColumn("class", F.col("key").bitwiseAND((1 << CLASS_BITS) - 1).cast("int")).join(points.select("sid", "first", "spare"), "sid")
    rows = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") > F.element_at("spare", F.col("class") - F.col("first") + 1))
    rows = materialise(rows.select("key", "sid"), "rare")
    # Members by a sum of hashes: each set's is mixed, so no two lists have the same but by chance.
    mark = F.sum(F.xxhash64("sid").cast("decimal(38,0)"))
    own = rows.groupBy("key").agg(mark.alias("mark"), F.count("*").alias("c")).where("c > 1")
    own = own.groupBy("mark", "c").agg(F.min("key").alias("key")).select("key")
    return materialise(rows.join(own, "key"), "shared", (rows,))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id.

    Two documents link when 100 * overlap >= percent * union of their sets of distinct shingles of width words (A-Z in
    lower case). component_id is the smallest id reachable by links. A null or empty text, or one without words, has no
    shingles and links with nothing; its component is its own id. Repeated rows and equal texts link. A null id is
    never the smallest unless a component has no other. An empty table gives an empty result; other columns don't matter.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    kind, arrow = id_type.simpleString(), to_arrow_type(id_type)
    docs = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    parts = parts_for(docs, "text")
    sent = pa.schema([("to", pa.int32()), ("doc_id", arrow), ("n", pa.int64()), ("sid", pa.int64()), ("first", pa.int32()), ("spare", pa.list_(pa.int32())), ("keys", pa.binary()), ("sids", pa.binary())])
    got = pa.schema([("doc_id", arrow), ("n", pa.int64()), ("sid", pa.int64()), ("first", pa.int32()), ("spare", pa.list_(pa.int32())), ("key", pa.int64()), ("sets", pa.int64())])
    boxed = docs.mapInArrow(_emit(width, percent, 4 * parts, sent), _DOC.format(id=kind)).withColumn("deal", F.coalesce(F.when(F.col("keys").isNull(), F.pmod(F.xxhash64("doc_id", "sid"), F.lit(4 * parts))), F.col("to"))).repartition(parts, "deal").drop("deal")
    boxed = materialise(boxed.mapInArrow(_shared_boxes(got), f"doc_id {kind}, n long, sid long, first int, spare array<int>, key long, sets long"), "boxes")
    points = materialise(boxed.where("key is null").select("doc_id", "n", "sid"), "points")
    lowest = boxed.where("key is null and n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("first").alias("first"), F.first("spare").alias("spare"))
    lowest = materialise(lowest, "lowest")
    shared = _rarest(boxed.where("key is not null").select("key", "sid", "sets"), lowest)
    drop(boxed)
    # The sets of those that share a box, from their texts.
    wanted = materialise(shared.select("sid").distinct().join(lowest, "sid").select("sid", F.col("doc_id").alias("_want")), "wanted")
    texts = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(wanted["_want"])).select("sid", "text")
    once = texts.mapInArrow(_sets(width), "sid long, n long, coarse binary, fine binary, hashes binary").dropDuplicates(["sid"])
    with bucketed(once, "sid", "sets", parts) as sets:
        comp = _components(shared, sets, percent, parts)
    drop(wanted, shared)
    named = lowest.select("sid", "doc_id").join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    low = materialise(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "low")
    named = materialise(named.join(low, "comp").select("sid", "component_id"), "named", (low, comp, lowest))
    out = points.where("n > 0").join(named, "sid").select("doc_id", "n", "component_id").union(points.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all columns: one of each group of linked documents (see link_documents).

    Of a group the row with the smallest id stays, null last; of rows with one id, that of the smallest hash of the row;
    of rows equal in all columns, one. Rows without words all stay.
    """
    inner = docs.select(*[F.col(quoted(c)).alias(f"_x{i}") for i, c in enumerate(docs.columns)])
    own, text = f"_x{docs.columns.index(id_col)}", f"_x{docs.columns.index(text_col)}"
    hashed = [c for c, kind in inner.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = inner.withColumn("_r", F.xxhash64(*hashed)).withColumn("_q", F.xxhash64(F.lit(1), *hashed))
    name = F.struct(F.col(own).isNull().alias("z"), F.col(own).alias("i"), F.col("_r").alias("r"), F.col("_q").alias("q"))
    linked = link_documents(keyed.select(name.alias("_name"), F.col(text).alias("_text")), "_name", "_text", width, percent)
    # The name's hashes hold the id too, so that they alone deal out the rows: for the join, and for the choice among equal rows.
    stay = linked.where(F.col("component_id").eqNullSafe(F.col("_name"))).groupBy(F.col("_name.r").alias("_r"), F.col("_name.q").alias("_q")).agg(F.max("n_shingles").alias("_n"))
    first = F.row_number().over(Window.partitionBy("_r", "_q").orderBy("_r"))
    out = keyed.join(stay.hint("merge"), ["_r", "_q"]).withColumn("_first", F.when(F.col("_n") > 0, first).otherwise(1)).where("_first = 1")
    return out.select(*[F.col(f"_x{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents"), width=4, percent=85)
