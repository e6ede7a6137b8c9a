"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

1. Of every window of `length` bytes, the K-byte string with the smallest hash is its anchor. Equal windows have equal
   anchors at equal places, so only texts that share an anchor can share a window. Anchors travel as packed bytes by
   shard; those that occur once in all distinct texts are dropped, with all their windows.
2. A segment is an anchor's place with all windows that it stands for. Segments meet in the shard of their anchor. Equal
   ones are one string with several places: all their windows repeat. What differs is joined into the shard's string, if
   its left and right neighbours in sorted order agree with it in enough bytes to share a window at all.
3. The shard's suffix array is built by induced sorting: suffixes are classified, leftmost-smaller ones named and sorted
   by pairs of names, twice as far each time, and all others induced from them bucket by bucket. Common prefixes of
   neighbours, permuted into text order, tell which windows repeat.
Texts that are equal are one text; if it is long enough, all of it repeats.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import materialise, read_table, shuffle_partitions
from ._hashing import _BACK, _BYTE, _STEP, CHUNK, U, _power, mix, shard_rows

LENGTH = 200
K = 64
_PLACE = 32  # bits for a place in a chunk; a Spark string has less than 2^31 bytes


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """For each anchor of each text: text number, place, hash, and the first and last window that it stands for."""
    parts, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end])
            end += 1
        parts.append(_anchors(texts[at:end], at, length, k))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def _anchors(texts: list[bytes], first: int, length: int, k: int) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    if len(b) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, np.int64, np.int64))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(_BYTE[b] * _power("on", _STEP, len(b))[: len(b)], dtype=U)])
        h = mix((sums[k:] - sums[:-k]) * _power("back", _BACK, len(b))[: len(b) - k + 1])
    low = U((1 << _PLACE) - 1)
    best, span, width = (h & ~low) | np.arange(len(h), dtype=U), 1, length - k + 1
    while span * 2 <= width:
        best, span = np.minimum(best[:-span], best[span:]), span * 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    best = (best & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(best)), "right")
    ok = np.arange(len(best)) + length <= ends[text]
    window, place, text = np.flatnonzero(ok), best[ok], text[ok]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(place) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(place)) - 1
    t = text[new]
    return t + first, place[new] - starts[t], h[place[new]], window[new] - starts[t], window[last] - starts[t] if len(new) else window[new]


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte string in the order of (at least) their first depth bytes, by induced sorting."""
    n = len(s)
    s = np.append(s.astype(np.int64) + 1, 0)  # the end is the smallest
    step = np.sign(s[1:] - s[:-1])
    # Type: smaller (1) if the next different character is larger. The end is a smaller one.
    at = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(np.append(step, -1)[nxt] > 0, True)
    lms = np.flatnonzero(small[1:n] & ~small[: n - 1]) + 1
    order = _by_names(s, small, lms, depth)
    count = np.bincount(s, minlength=258)
    tail = np.cumsum(count)
    sa = np.full(n + 1, -1, np.int64)
    own = s[order]
    back = np.searchsorted(own, own, "right") - np.arange(len(own))
    sa[tail[own] - back] = order
    heads, used = tail - count, np.flatnonzero(count)
    filled = heads.copy()
    for c in used:  # larger suffixes, left to right
        lo = heads[c]
        while lo < filled[c]:
            hi = filled[c]
            _push(s, small, sa, sa[lo:hi], filled, True)
            lo = hi
        rest = sa[max(lo, heads[c]) : tail[c]]
        _push(s, small, sa, rest[(rest >= 0) & small[rest]], filled, True)
    ends = tail.copy()
    for c in used[::-1]:  # smaller suffixes, right to left
        hi = ends_at = tail[c]
        while hi > ends[c] or hi == ends_at:
            lo = ends[c]
            if hi > lo:
                _push(s, small, sa, sa[lo:hi][::-1], ends, False)
            if ends[c] == lo:
                break
            hi = lo
        part = sa[heads[c] : filled[c]]  # the bucket's larger suffixes
        _push(s, small, sa, part[::-1], ends, False)
    return sa[1:]


def _push(s: np.ndarray, small: np.ndarray, sa: np.ndarray, suffixes: np.ndarray, edge: np.ndarray, left: bool) -> None:
    """Put the suffixes one character before these, if of the wanted type, at their buckets' edges, in this order."""
    before = suffixes[suffixes > 0] - 1
    before = before[small[before] != left]
    if not len(before):
        return
    c = s[before]
    order = np.argsort(c, kind="stable")
    c, before = c[order], before[order]
    rank = np.arange(len(c)) - np.searchsorted(c, c)
    if left:
        sa[edge[c] + rank] = before
    else:
        sa[edge[c] - 1 - rank] = before
    edge += np.bincount(c, minlength=len(edge)) * (1 if left else -1)


def _by_names(s: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The end and the leftmost-smaller suffixes, in order of their first depth bytes or to the end.

    A leftmost-smaller substring runs from one such place to the next. Substrings get names in their order; suffixes are
    then sequences of names, and are sorted by pairs of names until all differ or depth bytes are covered.
    """
    if not len(lms):
        return np.array([len(s) - 1])
    size = np.diff(np.append(lms, len(s) - 1)) + 1
    # A character's type is part of it, larger types last: then no substring begins with another. Compared 6 at a time.
    order, name = np.arange(len(lms)), np.zeros(len(lms), np.int64)
    typed = np.append(s * 2 + small, np.zeros(8, np.int64)).astype(U)
    word = np.zeros(len(s), U)
    for i in range(6):
        word = (word << U(10)) | typed[i : i + len(s)]
    live, step = np.arange(len(lms)), 0
    while len(live):
        pad = U(10) * (6 - np.clip(size[live] - 6 * step, 0, 6)).astype(U)
        w = word[np.minimum(lms[live] + 6 * step, len(s) - 1)] >> pad << pad
        o = np.lexsort([w, name[live]])
        a, b = name[live][o], w[o]
        other = np.concatenate([[True], a[1:] != a[:-1]])
        group = np.maximum.accumulate(np.where(other, np.arange(len(o)), 0))
        start = np.maximum.accumulate(np.where(other | np.concatenate([[True], b[1:] != b[:-1]]), np.arange(len(o)), 0))
        name[live[o]] = a + (start - group)
        step += 1
        tied = np.bincount(name, minlength=len(lms) + 1)[name[live]] > 1
        live = live[tied & (size[live] > 6 * step)]
    covered, gap = size - 1, 1
    while True:
        nxt = np.append(name[gap:], np.full(min(gap, len(name)), -1))[: len(name)]
        order = np.lexsort([nxt, name])
        a, b = name[order], nxt[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        name = np.empty_like(name)
        name[order] = np.cumsum(new) - 1
        covered = covered + np.append(covered[gap:], np.full(min(gap, len(covered)), 1 << 40))[: len(covered)]
        gap *= 2
        if new.all() or covered.min() >= depth:
            return np.append(len(s) - 1, lms[order])


def common_prefixes(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths, up to most, of the common prefixes of suffixes a and b."""
    pad = np.append(s, np.zeros(8, np.uint8))
    word = np.lib.stride_tricks.as_strided(pad, (len(s) + 1, 8), (1, 1))
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, most, 8):
        x, y = a[live] + at, b[live] + at
        inside = (x < len(s)) & (y < len(s))
        eq = np.zeros((len(live), 8), bool)
        eq[inside] = word[x[inside]] == word[y[inside]]
        run = np.where(eq.all(1), 8, eq.argmin(1))
        out[live] += run
        live = live[run == 8]
        if not len(live):
            break
    return np.minimum(out, most)


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, the starts of windows of length bytes that occur in another place of these strings."""
    s = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(x) for x in strings])
    starts = ends - [len(x) for x in strings]
    sa = suffix_array(s, length)
    own = np.searchsorted(ends, sa, "right")
    sa = sa[sa + length <= ends[np.minimum(own, len(ends) - 1)]]
    same = common_prefixes(s, sa[:-1], sa[1:], length) >= length
    again = np.zeros(len(s) + 1, bool)  # in text order
    again[sa[:-1][same]] = True
    again[sa[1:][same]] = True
    return [np.flatnonzero(again[a:b]) for a, b in zip(starts, ends)]


def _emit(length: int, k: int, shards: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tids = b.column(0).to_numpy()
            text, place, h, _, _ = anchors([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(1)], length, k)
            rows = [{"to": s, "keys": x.tobytes(), "tids": t.tobytes(), "places": p.tobytes()} for s, x, t, p in shard_rows(h.astype(U), shards, tids[text], place.astype("<u4"))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, place) of anchors of a shard that are in two places or more."""
    got = [[], [], []]
    for b in batches:
        for x, name, kind in zip(got, ("keys", "tids", "places"), (U, np.int64, "<u4")):
            x += [np.frombuffer(v, kind) for v in b.column(name).to_pylist()]
    if not got[0]:
        return
    k, t, p = (np.concatenate(x) for x in got)
    order = np.lexsort([p, t, k])
    k, t, p = k[order], t[order], p[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
    k, t, p = k[new], t[new], p[new]
    twin = k[1:] == k[:-1]
    many = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
    t, p = t[many], p[many].astype(np.int64)
    order = np.lexsort([p, t])
    t, p = t[order], p[order]
    edges = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]]) if len(t) else np.zeros(1, np.int64)
    for i in range(0, len(edges) - 1, 5000):
        e = edges[i : i + 5001]
        yield pa.RecordBatch.from_arrays([pa.array(t[e[:-1]]), pa.array([p[x:y].astype("<u4").tobytes() for x, y in zip(e, e[1:])], pa.binary())], names=["tid", "places"])


def _segments(length: int, k: int, shards: int, schema: pa.Schema):
    """Segments of texts (tid, bytes, list of packed places) by shard of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tids, texts = b.column(0).to_numpy(), [x.as_buffer().to_pybytes() for x in b.column(1)]
            text, place, h, first, last = anchors(texts, length, k)
            hot = [np.concatenate([np.frombuffer(x, "<u4") for x in xs]).astype(np.int64) for xs in b.column(2).to_pylist()]
            wanted = np.concatenate([np.zeros(0, np.int64), *((i << 32) + x for i, x in enumerate(hot))])
            keep = np.flatnonzero(np.isin((text << 32) + place, wanted))
            out = defaultdict(list)
            for i in keep.tolist():
                out[int((h[i] >> U(33)) % U(shards))].append(i)
            rows = []
            for s, own in out.items():
                pieces = [texts[text[i]][first[i] : last[i] + length] for i in own]
                rows.append({"to": s, "keys": h[own].astype(U).tobytes(), "tids": tids[text[own]].tobytes(), "places": np.stack([place[own], first[own]]).astype("<u4").tobytes(), "sizes": np.array([len(x) for x in pieces], "<u4").tobytes(), "data": b"".join(pieces)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _may_share(strings: list[bytes], anchor: list[int], length: int, k: int) -> list[int]:
    """Which strings agree, around their anchor, with others in at least length bytes."""
    need = length - k

    def reach(sides: list[bytes]) -> list[int]:
        order = sorted(range(len(sides)), key=sides.__getitem__)
        out = [0] * len(sides)
        for x, y in zip(order, order[1:]):
            a, b = sides[x], sides[y]
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                lo, hi = 0, n
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
                n = lo
            out[x], out[y] = max(out[x], n), max(out[y], n)
        return out

    right = reach([s[a + k :] for s, a in zip(strings, anchor)])
    left = reach([s[:a][::-1] for s, a in zip(strings, anchor)])
    return [i for i, (x, y) in enumerate(zip(left, right)) if x + y >= need]


def _find(length: int, k: int):
    """Runs of bytes to remove, from a shard's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[bytes, list]] = defaultdict(dict)
        for b in batches:
            for r in b.to_pylist():
                keys, tids, sizes = np.frombuffer(r["keys"], U).tolist(), np.frombuffer(r["tids"], np.int64).tolist(), np.frombuffer(r["sizes"], "<u4").tolist()
                place, first = np.frombuffer(r["places"], "<u4").reshape(2, -1).tolist()
                at = 0
                for key, tid, n, p, f in zip(keys, tids, sizes, place, first):
                    groups[key].setdefault(r["data"][at : at + n], []).append((tid, f, p - f))
                    at += n
        strings, owners, found = [], [], []
        for group in groups.values():
            texts = list(group)
            for x in texts:
                if len(group[x]) > 1:
                    found += [(tid, f, f + len(x)) for tid, f, _ in group[x]]
            if len(texts) > 1:
                for i in _may_share(texts, [group[x][0][2] for x in texts], length, k):
                    strings.append(texts[i])
                    owners.append(group[texts[i]])
        groups.clear()
        batch, size = [], 0
        if strings:
            for places, starts, x in zip(owners, repeated_windows(strings, length), strings):
                if len(places) == 1 and len(starts):
                    gap = np.flatnonzero(np.diff(starts) > 1)
                    lo, hi = starts[np.concatenate([[0], gap + 1])], starts[np.append(gap, len(starts) - 1)] + length
                    tid, f, _ = places[0]
                    found += [(tid, f + int(a), f + int(b)) for a, b in zip(lo, hi)]
        del batch, size
        for i in range(0, len(found), 50_000):
            part = found[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part)], names=["tid", "lo", "hi"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, bytes, runs) to what is removed: bytes, maximal runs, and the text that stays."""
    for b in batches:
        tids, n, spans, kept = b.column(0), [], [], []
        for text, runs in zip(b.column(1), b.column(2).to_pylist()):
            text, out, at, cuts = text.as_buffer().to_pybytes(), [], 0, 0
            end = -1
            for r in sorted((r["lo"], r["hi"]) for r in runs):
                if r[0] > end:
                    out.append(text[at : r[0]])
                    cuts += 1
                end = max(end, r[1])
                at = end
            out.append(text[at:])
            kept.append(b"".join(out))
            n.append(len(text) - len(kept[-1]))
            spans.append(cuts)
        yield pa.RecordBatch.from_arrays([tids, pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["tid", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    Each byte covered by a string of length bytes that starts in two places or more, of one text or of two, is removed;
    what repeats is judged on the input. A null or empty text has no bytes. Equal texts and repeated rows of at least
    length bytes vanish whole. An empty table gives an empty result; other columns don't matter.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    shards, n_shards = 4 * parts, 4 * parts
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("b")).withColumn("tid", F.xxhash64(F.octet_length("b"), "b"))
    fields = [("to", pa.int32()), ("keys", pa.binary()), ("tids", pa.binary()), ("places", pa.binary())]
    sent = rows.select("tid", "b").mapInArrow(_emit(length, k, shards, pa.schema(fields)), "to int, keys binary, tids binary, places binary").repartition(parts, "to")
    shared = materialise(sent.mapInArrow(_shared, "tid long, places binary"), "anchors")
    same = materialise(rows.groupBy("tid").agg(F.count("*").alias("copies"), F.min("_id").alias("_first")), "texts")
    places = shared.groupBy("tid").agg(F.collect_list("places").alias("places")).join(same.select("tid", "_first"), "tid")
    hot = rows.join(places.hint("merge").withColumnRenamed("tid", "_tid"), (F.col("tid") == F.col("_tid")) & F.col("_id").eqNullSafe(F.col("_first"))).select("tid", "b", "places")
    hot = materialise(hot.dropDuplicates(["tid"]), "hot")
    fields += [("sizes", pa.binary()), ("data", pa.binary())]
    sent = hot.mapInArrow(_segments(length, k, n_shards, pa.schema(fields)), "to int, keys binary, tids binary, places binary, sizes binary, data binary").repartition(parts, "to")
    runs = materialise(sent.mapInArrow(_find(length, k), "tid long, lo long, hi long"), "runs")
    runs = runs.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    cut = materialise(hot.select("tid", "b").join(runs, "tid").mapInArrow(_cut_out, "tid long, n_removed long, n_spans long, kept binary"), "cut")
    verdict = same.join(cut, "tid", "left").where("copies > 1 or kept is not null").select("tid", "copies", "n_removed", "n_spans", "kept")
    verdict = materialise(verdict, "verdict")
    n = F.octet_length("b").cast("long")
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (n >= length)
    out = rows.join(verdict.hint("merge"), "tid", "left")
    return out.select(
        F.col("_id").alias(id_col), n.alias("n_bytes"), F.when(whole, n).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "b")).alias("kept"),
    )


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
