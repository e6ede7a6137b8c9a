"""Encoding of text pieces by a tokenizers file, with a bounded table of the pieces already known."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: A table is emptied before it would hold more pieces (about 80 MB); a worker keeps it from task to task.
MOST_PIECES = 400_000
BATCH_BYTES = 1 << 18
#: Pieces joined into one string for the library, with MARK between them.
JOINED = 200
MARK = "\x01"
#: Longer words are encoded each time: a full table of words is bounded in bytes too.
LONGEST_KEPT = 64
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_tables: dict[tuple, PieceTable] = {}
_words: dict[str, WordTable] = {}


def byte_batches(items: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about limit bytes; a larger item is a batch of its own."""
    batch, size = [], 0
    for x in items:
        n = len(x.encode())
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(x)
        size += n
    if batch:
        yield batch


class PieceTable:
    """Ids (little-endian unsigned 32-bit) or their number for pieces that the tokenizer treats independently.

    New pieces go to the library joined by MARK, which it encodes by an id that nothing else gives; pieces that hold
    MARK or a special string, or lack the space that pieces begin with, go there one by one.
    """

    def __init__(self, path: str, lead: str, counts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        self.tokenizer, self.lead, self.counts, self.known = Tokenizer.from_file(path), lead, counts, {}
        special = [MARK, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.mark = self.tokenizer.encode(" " + MARK, add_special_tokens=False).ids

    def alone(self, x: str) -> bool:
        return not x.startswith(self.lead) or self.special.search(x) is not None

    def learn(self, new: list[str]) -> None:
        plain, odd = [], []
        for x in new:
            (odd if self.alone(x) else plain).append(x)
        for batch in byte_batches(odd):
            for x, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                self.known[x] = len(e) if self.counts else np.array(e.ids, "<u4").tobytes()
        between, last, width = (f" {MARK}" if self.lead else f" {MARK} "), self.mark[-1], len(self.mark)
        for batch in byte_batches(plain):
            groups = [batch[i : i + JOINED] for i in range(0, len(batch), JOINED)]
            texts = [between.join(g) + " " + MARK for g in groups]
            for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(ids == last) - width + 1
                starts = np.concatenate([[0], ends[:-1] + width])
                if self.counts:
                    self.known.update(zip(g, (ends - starts).tolist(), strict=True))
                else:
                    b = ids.tobytes()
                    self.known.update((x, b[i:j]) for x, i, j in zip(g, (4 * starts).tolist(), (4 * ends).tolist(), strict=True))

    def of(self, texts: list[list[str]]) -> Iterator[list]:
        """The known values of each text's pieces. Each text's new pieces are learnt first, several texts at a time."""
        known, at = self.known, 0
        while at < len(texts):
            new, size, end = set(), 0, at
            while end < len(texts) and size < BATCH_BYTES:
                new |= set(texts[end]).difference(known)
                size += sum(map(len, texts[end]))
                end += 1
            if known and len(known) + len(new) > MOST_PIECES:
                known.clear()  # and with it what these texts share with earlier ones
                new = set().union(*texts[at:end])
            self.learn(list(new))
            for pieces in texts[at:end]:
                yield list(map(known.__getitem__, pieces))
            at = end


class WordTable(dict):
    """Ids (little-endian unsigned 32-bit) by word, encoded by the tokenizer's model when first asked for.

    A word is what the tokenizer's normaliser leaves as it is and its pre-tokenizer takes whole: neither runs here. When
    half of MOST_PIECES are known they become the older half, from which a word that comes again is taken over, so
    frequent words are not encoded anew.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenize, self.older = tokenizer.model.tokenize, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
            ids = np.array([t.id for t in self.tokenize(shown)], "<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def table(path: str, lead: str, counts: bool) -> PieceTable:
    """One for each worker process, kept from task to task."""
    if (path, lead, counts) not in _tables:
        _tables[path, lead, counts] = PieceTable(path, lead, counts)
    return _tables[path, lead, counts]


def word_table(path: str) -> WordTable:
    """One for each worker process, kept from task to task."""
    if path not in _words:
        _words[path] = WordTable(table(path, "", counts=False).tokenizer)
    return _words[path]
