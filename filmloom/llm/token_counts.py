"""Token counts: Arrow batches are encoded by the tokenizer's library, and only lengths come back.

Texts are split at safe boundaries: before a space that a character other than white space follows. The byte-level
pre-tokenizer always starts a token there (a run of white space gives its last space to the next token), so a text's count is the sum over its pieces.
Pieces repeat a lot: each distinct one is encoded once while the bounded table of known pieces holds it, and new pieces
go to the library in batches of about equal bytes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import read_table
from ._pieces import table

#: A space that may not begin a piece: white space or the end of the text follows.
_UNSAFE = re.compile(r" (?=\s|\Z)")


def pieces(text: str) -> list[str]:
    """The text's pieces between safe boundaries."""
    parts = text.split(" ")
    if _UNSAFE.search(text) is None:
        return parts[:1] + [" " + p for p in parts[1:]]
    out = parts[:1]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (more than limit tokens) for each row of docs.

    A null text counts as empty: 0 bytes and 0 tokens. Special strings in a text are read as the library does by
    default. Repeated rows are counted each; an empty table gives an empty result; other columns don't matter.
    """

    def run(batches):
        known = table(tokenizer_path, " ", counts=True)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            tokens = [sum(x) for x in known.of([pieces(x) for x in texts])]
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
