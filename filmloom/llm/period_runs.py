"""Periodic runs of words by harmonic grid probing.

A stretch in which words p apart are equal over at least p places holds a multiple j * p, so only the words at jp and
(j + 1)p are compared: n ln n probes for all periods. Periods are taken in octaves [P, 2P), where none is a multiple of
another; probes within a run found in an earlier octave, whose period divides p, are skipped. The others are extended, in
chunks that grow, up to the next grid point of the same period, where the next probe goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import read_table, two_columns
from ._hashing import text_batches

#: Probes that are extended at a time, and the places of the largest chunk.
SLICE, CHUNK = 1 << 16, 256


def _probes(w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, p) of all multiples i of p with w[i] == w[i + p], for low <= p < high."""
    n, found = len(w), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if low * low <= n:  # few periods, many multiples
        for p in range(low, high):
            i = np.flatnonzero(w[: n - p : p] == w[p::p]) * p
            found.append((i, np.full(len(i), p)))
    else:  # a multiple of all periods at a time
        for j in range(n // low):
            last = min(high - 1, (n - 1) // (j + 1))
            if last < low:
                break
            here = w[j * low : j * last + 1 : j] if j else w[0]
            p = np.flatnonzero(here == w[(j + 1) * low : (j + 1) * last + 1 : j + 1]) + low
            found.append((j * p, p))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _reach(w: np.ndarray, i: np.ndarray, p: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many places on from i, in steps of 1 or -1 and at most limit of them, words p apart stay equal."""
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), SLICE):
        live, done, chunk = np.arange(at, min(at + SLICE, len(i))), 0, 4
        while len(live):
            k = np.arange(done, done + chunk)
            place = np.clip(i[live, None] + step * (k + 1), 0, len(w) - 1)
            same = (w[place] == w[np.minimum(place + p[live, None], len(w) - 1)]) & (k < limit[live, None])
            full = same.all(1)
            out[live] += np.where(full, chunk, same.argmin(1))
            live, done, chunk = live[full], done + chunk, min(chunk * 4, CHUNK)
    return out


def find_runs(w: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period) of all runs in w, by start, then period.

    A run is a stretch with smallest period p and a length of at least max(least, 2p) that cannot be made longer with
    that period. w: words as numbers, equal for equal words.
    """
    n, known = len(w), {}
    low = 1
    while 2 * low <= n:
        high = min(2 * low, n // 2 + 1)
        i, p = _probes(w, low, high)
        for q, (starts, ends) in known.items():  # runs of one period, in order of start and so of end
            at = np.searchsorted(starts, i, "right") - 1
            new = (p % q != 0) | (at < 0) | (ends[at] <= i + p)
            i, p = i[new], p[new]
        order = np.lexsort([i, p])
        i, p = i[order], p[order]
        ahead = _reach(w, i, p, np.minimum(p - 1, n - 1 - p - i), 1)
        joined = np.zeros(len(i) + 1, bool)  # to the probe before; a last one that is joined to nothing ends the last chain
        joined[1:-1] = (p[1:] == p[:-1]) & (i[1:] == i[:-1] + p[:-1]) & (ahead[:-1] == p[:-1] - 1)
        first, last = np.flatnonzero(~joined[:-1]), np.flatnonzero(~joined[1:])
        start = i[first] - _reach(w, i[first], p[first], np.minimum(p[first] - 1, i[first]), -1)
        same, p = i[last] + ahead[last] + 1 - start, p[first]
        keep = (same >= p) & (same + p >= least)
        for q in np.unique(p[keep]):
            own = keep & (p == q)
            known[int(q)] = start[own], start[own] + same[own] + q
        low *= 2
    rows = [np.stack([s, e - s, np.full(len(s), q)], 1) for q, (s, e) in known.items()]
    rows = np.concatenate([np.zeros((0, 3), np.int64), *rows])
    return rows[np.lexsort([rows[:, 2], rows[:, 0]])]


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, len(words))


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """id_col, n_words, runs (start, length, period of each, by start, then period), collapsed (the words that stay, joined by one space) for each row of docs.

    Words are runs of other characters than space and 9 to 13, numbered from 0, in their case. rewrite: a function of a
    row's id and words that gives the words to search. A null text, like an empty one, has no words, no runs and an empty
    collapsed text. Repeated rows are searched each; an empty table gives an empty result; other columns don't matter. A
    text is searched whole in one task, in memory that grows with that text alone; nothing is shuffled.
    """
    three = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def run(batches):
        for ids, texts in text_batches(batches):
            sizes, runs, left = [], [], []
            for key, text in zip(ids, texts):
                words = text.encode().split()
                words = rewrite(key, words) if rewrite else words
                found = find_runs(_numbers(words), least)
                sizes.append(len(words))
                runs.append(found)
                left.append(b" ".join(collapse(words, found)).decode())
            flat = np.concatenate(runs)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(three)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sizes, pa.int64()), spans, pa.array(left, pa.string())], names=["_id", "n_words", "runs", "collapsed"])

    kind = to_arrow_type(docs.schema[id_col].dataType)
    found = two_columns(docs, id_col, text_col).mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("_id", id_col)


def repeat_tail(key: object, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in a tenth of the documents, as the id's CRC-32 says where."""
    h = crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_period_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, with repeat_tail's planted ones; digests of the operator's runs and texts."""
    found = period_runs(read_table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("low"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(reduce(lambda a, b: F.concat(a, F.lit(","), b), [r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.low"), F.col("best.period")
    milli = F.floor((length * 1000 - F.pmod(length * 1000, period)) / period)
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
