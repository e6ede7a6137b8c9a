"""Sentences and shortened texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filmloom.functions.names import clean_text

#: Titles whose full stop ends no sentence.
TITLES = ("Mr", "Mrs", "Ms", "Dr")


def truncate_text(text: Column, most: int) -> Column:
    """Clean text of at most `most` characters; a longer one ends at a word, with ... for its full stops. Null is empty."""
    clean = clean_text(text)
    cut = F.trim(F.regexp_replace(F.substring(clean, 1, most), " [^ ]*$", ""))
    return F.when(F.char_length(clean) <= most, clean).otherwise(F.concat(F.regexp_replace(cut, r"\.+$", ""), F.lit("...")))


def sentences(text: Column) -> Column:
    """The sentences of a text in order: they end at . ! or ? before a space, but not at a title's full stop. None in a null or empty one."""
    ends = rf"(?<=[.!?])(?<!\b(?:{'|'.join(TITLES)})\.) "
    return F.filter(F.split(clean_text(text), ends), lambda s: s != "")


def greedy_excerpt(lines: Column, most: int = 420) -> Column:
    """The first lines, joined by blanks, as long as they take at most `most` characters with a blank each; the first that does not fit ends it."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("total"), F.lit(False).alias("full"))

    def add(acc: Column, line: Column) -> Column:
        full = acc["full"] | (acc["total"] + F.char_length(line) + 1 > most)
        return F.struct(F.when(full, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(line))).alias("parts"), F.when(full, acc["total"]).otherwise(acc["total"] + F.char_length(line) + 1).alias("total"), full.alias("full"))

    return F.trim(F.aggregate(F.coalesce(lines, F.array().cast("array<string>")), start, add, lambda acc: F.array_join(acc["parts"], " ")))


def sentence_excerpt(text: Column, most_sentences: int = 2, most: int = 320) -> Column:
    """The first sentences of a text that fit, at most so many; where not even the first does, the text cut short. They end at . ! or ? before white space."""
    parts = F.filter(F.split(clean_text(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    some = greedy_excerpt(F.slice(parts, 1, most_sentences), most)
    return F.when(some != "", some).otherwise(truncate_text(text, most))


def _plain_name(text: Column) -> Column:
    out = F.replace(F.regexp_replace(clean_text(text), r"\(.*?\)", ""), F.lit("'s"), F.lit(" "))
    return F.lower(F.trim(F.regexp_replace(out, r"[^A-Za-z0-9]+", " ")))


def dialogue_lines(lines: Column) -> Column:
    """Clean lines of speech: two letters at least and 45 % of letters; of a short one, up to four words, the first two."""
    clean = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda t: F.struct(clean_text(t).alias("t"), _plain_name(t).alias("n"), F.char_length(F.regexp_replace(clean_text(t), r"[^\p{L}]", "")).alias("a")))
    good = F.filter(clean, lambda x: (x["a"] >= 2) & (x["a"] / F.char_length(x["t"]) >= 0.45) & (x["n"] != ""))

    def keep(all_: Column) -> Column:
        before = lambda x, i: F.size(F.filter(F.slice(all_, 1, i + 1), lambda y: y["n"] == x["n"]))
        return F.transform(F.filter(all_, lambda x, i: (F.size(F.split(x["n"], " ")) > 4) | (before(x, i) <= 2)), lambda x: x["t"])

    return F.element_at(F.transform(F.array(good), keep), 1)


def primary_dialogue(subtitle: Column, screenplay: Column, confidence: Column, quality: Column, from_script: Column, most: int = 900) -> Column:
    """text and source ("screenplay", "subtitle" or "none") of the better of two dialogues.

    quality: of the subtitle. A screenplay that is alone, or aligned with 0.7 at least, is taken; for a chunk that comes from
    the script also with 0.45, against a subtitle below 0.55, or if it is more than a third longer.
    """
    sub, play = F.substring(clean_text(subtitle), 1, most), F.substring(clean_text(screenplay), 1, most)
    sure = F.coalesce(confidence, F.lit(0.0))
    better = F.coalesce(from_script, F.lit(False)) & ((sure >= 0.45) | (quality < 0.55) | (F.char_length(play) >= F.floor(F.char_length(sub) * 1.35)))
    pick = lambda text, source: F.struct(text.alias("text"), F.lit(source).alias("source"))
    return F.when((play == "") & (sub == ""), pick(F.lit(""), "none")).when(sub == "", pick(play, "screenplay")).when(play == "", pick(sub, "subtitle")).when(better | (sure >= 0.70), pick(play, "screenplay")).otherwise(pick(sub, "subtitle"))
