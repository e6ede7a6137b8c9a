"""SubRip subtitles as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"
#: Where windows-1252 and Latin-1 differ.
_HIGH = "".join(map(chr, range(0x80, 0xA0)))
_SPAN = rf"{_TIME}\s*-->\s*{_TIME}"


def seconds(span: Column, first: int) -> Column:
    h, m, s, ms = (F.regexp_extract(span, _SPAN, first + i).cast("double") for i in range(4))
    return h * 3600 + m * 60 + s + ms / 1000


def clean_line(line: Column) -> Column:
    """A line without tags and without labels of who speaks: [NARRATOR:], (Man: or (Old Man: at any place; white space becomes single blanks."""
    for pattern in (r"<[^>]+>", r"\[[^\]]*:\]", r"\([A-Z][a-z]+:", r"\([A-Z][a-z]+\s+[A-Z][a-z]+:"):
        line = F.regexp_replace(line, pattern, "")
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, position, start_s, end_s, text of each cue of the files under path.

    Files are UTF-8, with or without a byte order mark, or else windows-1252, and with the replacement mark where that has no character. Blocks end at blank lines; the time code stands
    in one of a block's first two lines, and blocks without one or without text are left out. Tags go, and white space
    becomes single spaces. One file is one task's work, as a file is one film.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.translate(F.decode("content", "ISO-8859-1"), _HIGH, _HIGH.encode("latin-1").decode("cp1252", "replace")))
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    blocks = raw.select("path", F.posexplode(F.split(text, r"\n[ \t]*\n\s*")).alias("position", "block"))
    lines = blocks.withColumn("lines", F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n"))
    timed = lambda i: F.coalesce(F.get("lines", F.lit(i)).rlike(_SPAN), F.lit(False))
    at = F.when(timed(0), 0).when(timed(1), 1)
    cues = lines.withColumn("at", at).where("at IS NOT NULL").withColumn("span", F.get("lines", F.col("at")))
    said = F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), " ")
    said = F.trim(F.regexp_replace(F.regexp_replace(said, r"<[^>]*>|\{[^}]*\}", ""), r"\s+", " "))
    return cues.select("path", "position", seconds(F.col("span"), 1).alias("start_s"), seconds(F.col("span"), 5).alias("end_s"), said.alias("text")).where("text <> ''")


def _text_of(content: Column) -> Column:
    """UTF-8 with or without a byte order mark, or else Latin-1, with one kind of line end."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


_STRICT = r"(\d{2}):(\d{2}):(\d{2})[,\.](\d{3})"


def _cues(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path).select("path", _text_of(F.col("content")).alias("t"))
    blocks = raw.select("path", F.posexplode(F.split(F.regexp_replace("t", r"^\s+|\s+$", ""), "\n{2,}")).alias("position", "block"))
    return blocks.withColumn("lines", F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n"))


def _at(span: Column, pattern: str, first: int) -> Column:
    h, m, s, ms = (F.regexp_extract(span, pattern, first + i).cast("double") for i in range(4))
    return h * 3600 + m * 60 + s + ms / 1000


def read_script_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, position, start_s, end_s, text, as a script's chunks read subtitles: blocks have three lines at least, their second begins with the time, and labels of who speaks go."""
    span = rf"^{_STRICT}\s*-->\s*{_STRICT}"
    rows = _cues(spark, path).where((F.size("lines") >= 3) & F.get("lines", F.lit(1)).rlike(span)).withColumn("span", F.get("lines", F.lit(1)))
    said = F.array_join(F.transform(F.filter(F.slice("lines", 3, F.size("lines")), lambda x: x.rlike(r"\S")), clean_line), " ")
    return rows.select("path", "position", _at(F.col("span"), span, 1).alias("start_s"), _at(F.col("span"), span, 5).alias("end_s"), said.alias("text")).where("text <> ''")


def read_aligner_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, position, start_s, end_s, text, as an aligner reads subtitles: the time stands anywhere in a block; lines that are numbers or hold an arrow are no text, tags go."""
    span = rf"{_STRICT} --> {_STRICT}"
    rows = _cues(spark, path).where(F.col("block").rlike(span))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    own = F.filter(F.transform("lines", strip), lambda x: (x != "") & ~x.rlike(r"^\p{Nd}+$") & ~F.contains(x, F.lit("-->")))
    return rows.select("path", "position", _at(F.col("block"), span, 1).alias("start_s"), _at(F.col("block"), span, 5).alias("end_s"), strip(F.regexp_replace(F.array_join(own, " "), "<[^>]+>", "")).alias("text")).where("text <> ''")


def subtitle_files(cues: DataFrame, key: str, start: str, end: str, text: str) -> DataFrame:
    """key, srt: each key's cues as the text of a SubRip file, in order of start, numbered from 1 with those without text counted but left out.

    A film's cues make one text. Write it with partitionBy(key).text.
    """

    def clock(c: Column) -> Column:
        ms = F.round(c * 1000).cast("long")
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        return F.concat(two(F.floor(ms / 3_600_000)), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))

    one = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.coalesce(text, F.lit("")).alias("t"))
    every = cues.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("all"))
    lines = F.transform("all", lambda x, i: F.when(x["t"] != "", F.concat((i + 1).cast("string"), F.lit("\n"), clock(x["s"]), F.lit(" --> "), clock(x["e"]), F.lit("\n"), x["t"], F.lit("\n"))))
    return every.select(key, F.array_join(F.array_compact(lines), "\n").alias("srt"))
