"""Best-fit packing by minimum bin slack.

Documents become id sequences; a longer one than a sequence is cut into full pieces and a last one. Only the number of
pieces of each length matters for the plan, and there are at most `capacity` lengths, so the plan is made from that
bounded histogram: for each bin, a dynamic programme over bitsets of reachable sums finds the fullest feasible
combination of available lengths; it is removed as often as the histogram holds it. Pieces then take the plan's places
by their rank among pieces of their length. Ranks come from counts of (length, salt) and a window inside each, so that
no task holds all the pieces of a frequent length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, read_table
from ._pieces import PieceTable, WordTable, byte_batches, table, word_table

CAPACITY = 2048
SALTS = 64


#: Characters that lower-casing and composition treat one by one and alike in Python and in the tokenizer.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e]*")
#: The tokenizer's own division into letters, contractions, digits and other characters, for such texts in lower case.
#: Their letters are a to z and all beyond ASCII but the signs of times and division; such sets are faster than classes.
_TOKENS = re.compile(r"[^\x00-`{-\x7f\xd7\xf7]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-`{-~\xd7\xf7]+")


def is_plain(text: str) -> bool:
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


def encoded(texts: list[str], words: WordTable, pieces: PieceTable) -> Iterator[bytes]:
    """Each text's ids. The tokenizer drops white space and sees no further than from space to space; plain texts are divided into its own tokens."""
    plain = list(map(is_plain, texts))
    others = pieces.of([x.split(" ") for x, p in zip(texts, plain, strict=True) if not p])
    for x, p in zip(texts, plain, strict=True):
        yield b"".join(map(words.__getitem__, _TOKENS.findall(x.lower())) if p else next(others))


def cut(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces. Repeated parts of texts are mostly encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces = word_table(tokenizer_path), table(tokenizer_path, "", counts=False)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            few = byte_batches(x or "" for x in b.column(1).to_pylist())  # parts of a whole batch would take ten times its bytes
            for i, ids in enumerate(x + end for texts in few for x in encoded(texts, words, pieces)):
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[s : s + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, copies) of a fullest combination that counts (at index length) allows, found longest lengths first.

    Bit s of a bitset tells whether the lengths so far can sum to s. The search stops as soon as the full sum is reachable.
    """
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = min(int(counts[n]), capacity // n)
        k = 1
        while left:  # copies in powers of two give every number of copies up to left
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & full
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    s, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> s & 1:
            s -= n * k
            out[n] = out.get(n, 0) + k
    return sorted(out.items(), reverse=True)


def plan(counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Places: pieces of `length` with ranks from `first` on, `copies` to a bin in `bins` bins from `bin` on, from `offset` on in each."""
    counts, taken, rows, bin_ = counts.copy(), np.zeros(capacity + 1, np.int64), [], 0
    while counts.any():
        best = fullest(counts, capacity)
        times = min(int(counts[n]) // k for n, k in best)
        for (n, k), offset in zip(best, accumulate((n * k for n, k in best), initial=0)):
            rows.append((n, int(taken[n]), k, times, bin_, offset))
            taken[n] += k * times
            counts[n] -= k * times
        bin_ += times
    return pd.DataFrame(rows, columns=["length", "first", "copies", "bins", "bin", "offset"]).sort_values(["length", "first"], ignore_index=True)


def place(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """pieces (materialised, with a column length) with sequence_id and offset."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    per_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).toPandas()  # at most capacity * SALTS rows
    per_salt = per_salt.sort_values(["length", "_salt"])
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, per_salt["length"].to_numpy(np.int64), per_salt["_n"].to_numpy(np.int64))
    before = np.zeros((capacity + 1, SALTS), np.int64)
    before[per_salt["length"], per_salt["_salt"]] = per_salt.groupby("length")["_n"].cumsum() - per_salt["_n"]
    slots = plan(counts, capacity)
    # One ordered key, length * big + rank, finds a piece's slot by binary search.
    big = int(counts.max(initial=0)) + 1
    keys = (slots["length"] * big + slots["first"]).to_numpy(np.int64)
    first, copies, bin_, offset = (slots[c].to_numpy(np.int64) for c in ("first", "copies", "bin", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            n, salt, rank = (t[c].to_numpy().astype(np.int64) for c in ("length", "_salt", "_rank"))
            rank = rank - 1 + before[n, salt]
            i = np.searchsorted(keys, n * big + rank, "right") - 1
            r = rank - first[i]
            t = t.drop_columns(["_salt", "_rank"]).append_column("sequence_id", pa.array(bin_[i] + r // copies[i])).append_column("offset", pa.array(offset[i] + r % copies[i] * n))
            yield from t.to_batches()

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id alone. Documents of more than capacity ids are cut; a piece
    of capacity ids fills a sequence. Every piece gets exactly one place and a sequence's places leave no gap. Repeated
    rows are packed each; an empty table gives an empty result; other columns don't matter.
    """
    pieces = materialise(cut(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    return place(pieces, capacity, [id_col, "piece", "start", "ids_crc32"])


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
