"""64-bit hashes of words and word windows for whole batches of texts, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_STEP), -1, 2**64))
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        p = np.full(max(n, CHUNK + 2), base, U)
        p[0] = 1
        _powers[name] = np.cumprod(p, dtype=U)
    return _powers[name]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, text after text, and the number of words of each text.

    Words are runs of other bytes than space and 9 to 13. A word's hash is a polynomial in its bytes, got for all words
    at once from running sums, and mixed.
    """
    raw = [(t or "").encode().lower() for t in texts]
    out, counts, at = [], np.zeros(len(raw), np.int64), 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < CHUNK):
            size += len(raw[end]) + 1
            end += 1
        b = np.frombuffer(b"\n".join([b"", *raw[at:end], b""]), np.uint8)
        edge = np.diff(_IS_WS[b].astype(np.int8))
        start, stop = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([[U(0)], np.cumsum(_BYTE[b] * _power("on", _STEP, len(b))[: len(b)], dtype=U)])
            out.append(mix((sums[stop] - sums[start]) * _power("back", _BACK, len(b))[start] + (stop - start).astype(U)))
        first = np.cumsum([1, *(len(x) + 1 for x in raw[at:end])])
        counts[at:end] = np.diff(np.searchsorted(start, first))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U), counts


def text_batches(batches: Iterator, limit: int = 8 << 20) -> Iterator[tuple[list, list]]:
    """(ids, texts) of Arrow batches with an id and a text, in lists of about limit characters."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def shard_rows(keys: np.ndarray, shards: int, *more: np.ndarray) -> Iterator[tuple]:
    """(shard, keys, *more) for each shard that some key falls into."""
    shard = (keys >> U(33)) % U(shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=U))
    for s in np.flatnonzero(np.diff(edges)):
        i = order[edges[s] : edges[s + 1]]
        yield int(s), keys[i], *(m[i] for m in more)
