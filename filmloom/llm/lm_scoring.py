"""LM scoring with a weighted backoff automaton of word trigrams.

The automaton: a state for each history seen in training (none, a word or the start, two words), an arc for each n-gram
seen, and from each state a failure arc to the state of the history without its first word; the root has an arc for every
word. With Dirichlet smoothing,
    P(w) = (c(w) + 1) / (N + V + 1),   P(w | h) = (c(h w) + MU * P(w | h')) / (c(h) + MU),
where h' is h without its first word, an arc weighs log10 P(w | h) and a failure arc log10 MU / (c(h) + MU), so that the
weights on the way of an unseen word multiply up to its P(w | h); the arcs out of every state sum to one.

It never exists in one place. The corpus is cut into blocks of bounded size, written once. Each block counts its own
n-grams and sends (n-gram, count) to the shard of the n-gram, packed as bytes; texts stay where they are. A shard adds up
its n-grams over blocks and replies to each block with the totals of those that other blocks have too. Words and pairs go
first; of trigrams a block sends those alone whose two pairs other blocks have, as it knows the others' counts. A block
then builds the states and arcs that its texts can reach, and texts go through it from left to right, all in step: each
carries its state, follows failure arcs until there is an arc, and adds up weights. As a state remembers two words, long
texts are cut into runs that read the two words before them first. A frequent n-gram costs a shard one entry a block, so
no shard gets hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, quoted, read_table, shuffle_partitions
from ._hashing import U, mix, text_batches, word_hashes

MU = 20.0
ORDER = 3
#: Tokens in a block, about; a longer text makes a longer block.
BLOCK_TOKENS = 1 << 19
#: N-grams that a shard's task holds at a time, about, and shards a task.
TASK_GRAMS, SHARDS = 2_000_000, 4
#: Bytes of blocks or n-grams that go to Python at a time.
BATCH = 4 << 20
#: Tokens of a run.
RUN = 64
FOLDS, HELD_OUT = 7, 2
END, START = mix(np.array([1, 2], U))

_BLOCK = "block long, ids array<{id}>, lengths binary, vocab binary, seq binary, n_tokens long"
_SENT = "to int, block long, kind int, keys binary, counts binary"
_REPLY = "to int, block long, kind int, counts binary, n long, v long"


def gram_keys(history: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their histories and last words."""
    with np.errstate(over="ignore"):
        return mix(mix(history) * U(0x9FB21C651E98DF25) + cur)


def planes(a: np.ndarray) -> bytes:
    """32-bit numbers as byte planes: the upper ones, nearly all zeros, compress well."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def deltas(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences, which are small where keys are many."""
    return np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def undeltas(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=U)


def held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _batch(rows: list[dict], ddl_schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ddl_schema)


def _cut(schema: pa.Schema):
    """Cut a partition into blocks: ids, lengths, vocabulary by falling frequency, and texts as places in it."""

    def block(number: int, ids: list, words: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        counts = np.concatenate(counts)
        tokens, lengths = np.insert(np.concatenate(words), np.cumsum(counts), END), counts + 1
        vocab, inv, freq = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-freq, kind="stable")
        rank = np.empty(len(vocab), np.int64)
        rank[order] = np.arange(len(vocab))
        return _batch([{"block": number, "ids": ids, "lengths": lengths.astype("<i8").tobytes(), "vocab": vocab[order].tobytes(), "seq": planes(rank[inv]), "n_tokens": len(tokens)}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, words, counts, n = TaskContext.get().partitionId() << 24, [], [], [], 0
        for more, texts in text_batches(batches, 1 << 20):
            w, c = word_hashes(texts)
            ids += more
            words.append(w)
            counts.append(c)
            n += len(w) + len(c)
            if n >= BLOCK_TOKENS:
                yield block(number, ids, words, counts)
                number, ids, words, counts, n = number + 1, [], [], [], 0
        if ids:
            yield block(number, ids, words, counts)

    return run


class Grams:
    """A block's n-grams: for each order the words' or n-grams' hashes, their codes in the block and where they end."""

    def __init__(self, row: dict):
        self.ids, self.lengths, self.vocab = row["ids"], np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["vocab"], U)
        self.seq = unplanes(row["seq"]).astype(np.int64)
        self.held = np.array([held_out(i) for i in self.ids])
        self.train = np.repeat(~self.held, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        wide, start = len(self.vocab) + 1, len(self.vocab)
        prev = np.roll(self.seq, 1)
        prev[self.starts] = start
        two, self.at2 = np.unique(prev * wide + self.seq, return_inverse=True)
        self.first2, self.last2 = two // wide, two % wide
        words = np.append(self.vocab, START)
        self.keys2 = gram_keys(words[self.first2], words[self.last2])
        later = np.ones(len(self.seq), bool)
        later[self.starts] = False
        self.later = np.flatnonzero(later)
        three, self.at3 = np.unique(self.at2[self.later - 1] * wide + self.seq[self.later], return_inverse=True)
        self.history3, self.last3 = three // wide, three % wide
        self.keys3 = gram_keys(self.keys2[self.history3], self.vocab[self.last3])
        self.next3 = np.zeros(len(three), np.int64)  # the trigram's last two words
        self.next3[self.at3] = self.at2[self.later]

    def sent(self, kind: int, shared2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of an order: the places of the n-grams that are sent, as they are sent, their sorted hashes and own training counts; and the counts of all.

        shared2: the pairs that other blocks have too.
        """
        keys, at, train = {1: (self.vocab, self.seq, self.train), 2: (self.keys2, self.at2, self.train), 3: (self.keys3, self.at3, self.train[self.later])}[kind]
        own = np.bincount(at, train, len(keys)).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        if kind == 3:
            order = order[shared2[self.history3[order]] & shared2[self.next3[order]]]
        return order, keys[order], own[order], own

    def told(self, kind: int, replies: dict[tuple[int, int], bytes], shards: int, shared2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The corpus's counts of an order's n-grams, and which of them other blocks have too."""
        place, keys, _, count = self.sent(kind, shared2)
        edges = shard_edges(keys, shards)
        said = np.concatenate([np.zeros(0, "<u4"), *(unplanes(replies[kind, s]) for s, (x, y) in enumerate(zip(edges, edges[1:])) if y > x)]).astype(np.int64)
        count, shared = count.copy(), np.zeros(len(count), bool)
        shared[place] = said > 0
        count[place] = np.where(said > 0, said - 1, count[place])
        return count, shared


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the sorted keys of each shard, a range of hashes, begin and end."""
    return np.append(np.searchsorted(keys, np.arange(shards, dtype=U) * U((1 << 64) // shards)), len(keys))


def _said(row: dict) -> dict[tuple[int, int], bytes]:
    return {(r["kind"], r["to"]): r["counts"] for r in row["replies"] or ()}


def _send(shards: int, schema: pa.Schema, orders: tuple[int, ...]):
    """The n-grams of each block, by order and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                grams = Grams(row)
                shared2 = grams.told(2, _said(row), shards)[1] if 3 in orders else None
                for kind in orders:
                    _, keys, own, _ = grams.sent(kind, shared2)
                    edges = shard_edges(keys, shards)
                    yield _batch([{"to": s, "block": row["block"], "kind": kind, "keys": deltas(keys[x:y]), "counts": planes(own[x:y])} for s, (x, y) in enumerate(zip(edges, edges[1:])) if y > x], schema)

    return run


def _sum_shards(schema: pa.Schema):
    """Replies about a partition's n-grams, for each block in the order in which it sent them: the total and 1, or 0 if no other block has it."""

    def total(kind: int, parts: list) -> Iterator[pa.RecordBatch]:
        keys, own = np.concatenate([undeltas(p[2]) for p in parts]), np.concatenate([unplanes(p[3]) for p in parts])
        order = np.argsort(keys)
        k = keys[order]
        del keys
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sums, width = np.add.reduceat(own[order].astype(np.int64), first), np.diff(np.append(first, len(k)))
        del k
        if kind == 1:
            yield _batch([{"n": int(sums.sum()), "v": int((sums > 0).sum())}], schema)
        all_ = np.empty(len(own), np.int64)
        all_[order] = np.repeat(np.where(width > 1, sums + 1, 0), width)
        reply = np.split(all_, np.cumsum([len(p[3]) // 4 for p in parts])[:-1])
        for i in range(0, len(parts), 64):
            yield _batch([{"to": p[1], "block": p[0], "kind": kind, "counts": planes(x)} for p, x in zip(parts[i : i + 64], reply[i : i + 64])], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], list] = {}  # by order and shard, one of which is summed up at a time
        for b in batches:
            for r in b.to_pylist():
                got.setdefault((r["kind"], r["to"]), []).append((r["block"], r["to"], r["keys"], r["counts"]))
        for kind, to in list(got):
            yield from total(kind, got.pop((kind, to)))

    return run


class Automaton:
    """The states and arcs that a block's texts can reach, numbered in the block: 0 is the root.

    count[k] has the corpus's counts of the block's n-grams of order k.
    """

    def __init__(self, grams: Grams, count: dict[int, np.ndarray], mu: float, n: int, v: int):
        self.wide = len(grams.vocab) + 1
        end = int(np.flatnonzero(grams.vocab == END)[0])
        self.root = np.log10((count[1] + 1.0) / (n + v + 1.0))
        history = np.append(count[1], count[1][end])  # as many texts start as end
        one = np.where(history > 0, np.arange(1, len(history) + 1), 0)
        known = np.flatnonzero((count[2] > 0) & (grams.last2 != end))
        two = np.zeros(len(count[2]), np.int64)
        two[known] = len(history) + 1 + np.arange(len(known))
        size = len(history) + 1 + len(known)
        self.start, self.one = int(one[-1]), one
        self.fail, self.fail_weight = np.zeros(size, np.int64), np.zeros(size)
        self.fail_weight[1 : len(history) + 1] = np.log10(mu / (history + mu))
        self.fail[two[known]], self.fail_weight[two[known]] = one[grams.last2[known]], np.log10(mu / (count[2][known] + mu))
        p2 = (count[2] + mu * 10.0 ** self.root[grams.last2]) / (history[grams.first2] + mu)
        p3 = (count[3] + mu * p2[grams.next3]) / (count[2][grams.history3] + mu)
        seen2, seen3 = count[2] > 0, count[3] > 0
        arcs = np.concatenate([(one[grams.first2] * self.wide + grams.last2)[seen2], (two[grams.history3] * self.wide + grams.last3)[seen3]])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.target = np.concatenate([two[seen2], two[grams.next3][seen3]])[order]
        self.weight = np.log10(np.concatenate([p2[seen2], p3[seen3]]))[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after each word, and the log10 weights of the arcs on the way."""
        state, weight, left = state.copy(), np.zeros(len(state)), np.arange(len(state))
        after = self.one[word]
        while len(left):
            top = state[left] == 0
            done = left[top]
            weight[done] += self.root[word[done]]
            left = left[~top]
            key = state[left] * self.wide + word[left]
            at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            hit = self.arcs[at] == key if len(self.arcs) else np.zeros(len(left), bool)
            weight[left[hit]] += self.weight[at[hit]]
            after[left[hit]] = self.target[at[hit]]
            left = left[~hit]
            weight[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return after, weight

    def traverse(self, seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        runs = -(-lengths // RUN)
        text = np.repeat(np.arange(len(lengths)), runs)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = (np.cumsum(lengths) - lengths)[text] + nth * RUN
        stop = np.minimum(begin + RUN, np.cumsum(lengths)[text])
        state, score = np.where(nth == 0, self.start, 0), np.zeros(len(text))
        for k in range(-(ORDER - 1), RUN):
            live = np.flatnonzero((begin + k < stop) & ((nth > 0) | (k >= 0)))
            state[live], weight = self.step(state[live], seq[begin[live] + k])
            if k >= 0:
                score[live] += weight
        return np.bincount(text, score, len(lengths))


def _score(kind: pa.DataType, names: list[str], mu: float, n: int, v: int, shards: int):
    def score(row: dict) -> pa.RecordBatch:
        grams, said, count = Grams(row), _said(row), {}
        count[1], _ = grams.told(1, said, shards)
        count[2], shared2 = grams.told(2, said, shards)
        count[3], _ = grams.told(3, said, shards, shared2)
        model = Automaton(grams, count, mu, n, v)
        c = count[1][grams.seq]
        add = lambda x: np.add.reduceat(x, grams.starts)
        cols = [grams.held, grams.lengths, add((c > 0).astype(np.int64)), np.full(len(grams.ids), n, np.int64), add(model.root[grams.seq]), model.traverse(grams.seq, grams.lengths)]
        return pa.RecordBatch.from_arrays([pa.array(grams.ids, kind), *map(pa.array, cols)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield score(b.slice(k, 1).to_pylist()[0])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the automaton's).

    Texts with crc32(id as text) mod FOLDS equal to HELD_OUT are scored but not learnt from. A null or empty text is one
    end token; a null id counts as the empty string. Repeated rows are learnt from and scored each; an empty table gives
    an empty result; other columns don't matter.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    arrow, i, b = _arrow_type(spark, kind), pa.int64(), pa.binary()
    cut = pa.schema([("block", i), ("ids", pa.list_(arrow)), ("lengths", b), ("vocab", b), ("seq", b), ("n_tokens", i)])
    blocks = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(_cut(cut), _BLOCK.format(id=kind))
    blocks = materialise(blocks, "blocks", **{"parquet.block.size": 16 << 20})  # a task reads few blocks at a time
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-tokens * ORDER // (2 * TASK_GRAMS)))
    shards = SHARDS * parts
    sent = pa.schema([("to", pa.int32()), ("block", i), ("kind", pa.int32()), ("keys", b), ("counts", b)])
    reply = pa.schema([("to", pa.int32()), ("block", i), ("kind", pa.int32()), ("counts", b), ("n", i), ("v", i)])

    def ask(rows: DataFrame, *orders: int) -> DataFrame:
        rows = rows.mapInArrow(_send(shards, sent, orders), _SENT).repartition(parts, "to")
        return materialise(rows.mapInArrow(_sum_shards(reply), _REPLY), "replies", batch_bytes=BATCH)

    def told(replies: DataFrame) -> DataFrame:
        by_block = replies.where("kind is not null").groupBy("block").agg(F.collect_list(F.struct("kind", "to", "counts")).alias("replies"))
        return blocks.join(by_block.hint("merge"), "block", "left")

    first = ask(blocks, 1, 2)
    size = first.where("kind is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    second = ask(told(first), 3)
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = f"{quoted(id_col)} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = told(first.unionByName(second)).mapInArrow(_score(arrow, names, mu, size["n"] or 0, size["v"] or 0, shards), out)
    return materialise(scored, "scored", (blocks, first, second), batch_bytes=BATCH)


def _arrow_type(spark, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))
