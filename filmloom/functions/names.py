"""Keys and names: entity keys, relation types, plain fields, stems, clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, and the suffixes in the order in which they are tried.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
SUFFIXES = ("ing", "ers", "ies", "ied", "ed", "es", "s")


def clean_text(text: Column) -> Column:
    """Runs of white space as one space, none at either end; null as the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def plain_field(value: Column) -> Column:
    """In lower case, with one space for each run of other characters than a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def entity_key(name: Column) -> Column:
    """A name without what stands in brackets, as upper-case ASCII words."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", " ")
    return F.upper(F.trim(F.regexp_replace(out, "[^A-Za-z0-9]+", " ")))


def relation_type(value: Column) -> Column:
    """A relation's name as upper-case ASCII words joined by _; RELATED_TO if nothing is left, REL_ before a digit."""
    out = F.btrim(F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]+", "_"), F.lit("_"))
    out = F.when(out == "", F.lit("RELATED_TO")).otherwise(out)
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("REL_"), out)).otherwise(out)


def stem(word: Column) -> Column:
    """A word in lower case without the first of SUFFIXES that it ends in and is more than two letters longer than."""
    word = F.trim(F.lower(F.coalesce(word, F.lit(""))))
    out = F.when(F.lit(False), word)
    for s in SUFFIXES:
        out = out.when((F.length(word) > len(s) + 2) & word.endswith(s), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out.otherwise(word)
