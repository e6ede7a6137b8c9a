"""How alike two texts are, and pieces of a dialogue by which it may be found."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from filmloom.functions.text import _bind

#: Characters and words of a dialogue that can be searched for, words of its pieces.
LEAST_CHARS, LEAST_WORDS, PIECE = 18, 4, 10


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over those of both texts, as difflib counts them; null for a null text."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def bare(text: Column) -> Column:
    """Lower case without characters other than letters, digits, underscores and white space, and without white space at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", ""), r"^\s+|\s+$", "")


def words(bare_text: Column) -> Column:
    return F.filter(F.split(bare_text, r"\s+"), lambda w: w != "")


def is_substantial(text: Column) -> Column:
    return _bind(bare(text), lambda t: (F.length(t) >= LEAST_CHARS) & (F.size(words(t)) >= LEAST_WORDS))


def pieces(text: Column) -> Column:
    """The first, last and middle PIECE words of a text, each once; all of a shorter one; none of one without words."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        part = lambda start: F.array_join(F.slice(ws, start, PIECE), " ")
        three = F.array_distinct(F.array(part(F.lit(1)), part(F.greatest(F.lit(1), n - PIECE + 1)), part(F.greatest(F.lit(0), F.floor(n / 2).cast("int") - PIECE // 2) + 1)))
        return F.when(n > PIECE, three).when(n > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))

    return _bind(words(bare(text)), of)


def candidates(dialogues: Column, from_end: bool = False, most: int = 3) -> Column:
    """What to search a scene's start for, or its end: the first dialogues, or the last from the end on, each with its pieces.

    Only substantial ones; of those that are alike when bare, the first.
    """
    d = F.coalesce(dialogues, F.array().cast("array<string>"))
    chosen = F.reverse(F.slice(d, F.greatest(F.lit(1), F.size(d) - most + 1), most)) if from_end else F.slice(d, 1, most)
    all_ = F.flatten(F.transform(chosen, lambda t: F.concat(F.array(F.trim(F.coalesce(t, F.lit("")))), pieces(t))))
    good = F.filter(all_, is_substantial)
    keys = lambda ts: F.transform(ts, bare)
    return _bind(good, lambda ts: _bind(keys(ts), lambda ks: F.filter(ts, lambda t, i: F.array_position(ks, F.get(ks, i)) == i + 1)))
