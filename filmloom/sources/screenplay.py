"""Screenplays as blocks and scenes, by windows over lines: a long file is many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.operators.ranges import placed, running_sum

# What begins a scene, and how far a speaker's name and speech are set in.
HEADING = r"(?iU)^\s*(\d+)?\s*(INT\.?|EXT\.?|INT/EXT\.?|EXT/INT\.?|I/E)\s*[\.\-\s].{2,}"
HEADING_TEXT = r"(?iU)^\s*(\d+)?\s*((?:INT|EXT|INT/EXT|EXT/INT|I/E)[^\n]+)"
NAME_FROM, NAME_TO, NAME_CHARS, NAME_WORDS, SPEECH_FROM = 10, 45, 42, 5, 8


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, place, line of text files, split where Python's splitlines does; a file may be read in parts."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_nth"), "value")
    each = raw.select("path", "_start", "_nth", F.posexplode(F.split("value", "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")).alias("_part", "line"))
    return placed(each, "path", "_start", "_nth", "_part").select("path", "place", "line")


def blocks(lines: DataFrame, key: str, place: str = "place", line: str = "line") -> DataFrame:
    """key, at, kind (SceneHeading, Dialogue or Action), character, text, scene_num, scene: the blocks of each key's lines.

    A heading opens a scene, numbered from 1; blocks before the first one have scene 0. A line set in by 10 to 45 places, in
    capitals and short, is the name of who speaks next: the lines after it, set in by 8 at least, are the speech, until one
    that is not, which goes on as action. Blank lines count for nothing. `at` is the place of a block's first line. Places run from
    0 without gaps; null lines are blank.
    """
    text, own = F.coalesce(F.col(line), F.lit("")), F.col("_text")
    rows = lines.select(F.col(key), F.col(place).alias("at"), text.alias("_line"), _strip(text).alias("_text"))
    lead = F.length("_line") - F.length(F.regexp_replace("_line", r"(?U)^\s+", ""))
    rows = rows.withColumns({"_lead": lead, "_heading": (own != "") & F.regexp_like("_line", F.lit(HEADING))})
    upper = (own == F.upper(own)) & own.rlike("[A-Z]")
    short = (F.length(own) <= NAME_CHARS) & (F.size(F.split(own, r"(?U)\s+")) <= NAME_WORDS)
    plain = ~F.contains(F.substring(own, 2, NAME_CHARS), F.lit(".")) | F.contains(own, F.lit("("))
    rows = rows.withColumn("_name", ~F.col("_heading") & F.col("_lead").between(NAME_FROM, NAME_TO) & upper & short & plain)
    rows = running_sum(rows, key, "at", F.col("_heading").cast("long"), "scene")
    rows = running_sum(rows, key, "at", (F.col("_heading") | F.col("_name")).cast("long"), "_part").where(own != "")
    # A part begins with a heading or a name; what follows a name is speech up to the first line that is not set in.
    opened = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(
        F.max(F.when(F.col("_name"), own)).alias("_who"), F.min(F.when(~F.col("_name") & ~F.col("_heading") & (F.col("_lead") < SPEECH_FROM), F.col("at"))).alias("_ends")
    )
    rows = rows.join(opened, rows[key].eqNullSafe(opened["_key"]) & (F.col("_part") == F.col("_p"))).where("NOT _name")
    spoken = F.col("_who").isNotNull() & (F.col("_ends").isNull() | (F.col("at") < F.col("_ends")))
    kind = F.when(F.col("_heading"), "SceneHeading").when(spoken, "Dialogue").otherwise("Action")
    said = rows.withColumn("kind", kind).groupBy(key, "_part", "kind").agg(
        F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_text"))), lambda x: x["_text"]), " ").alias("text"),
        F.first(F.when(F.col("kind") == "Dialogue", F.col("_who"))).alias("character"), F.max("scene").alias("scene"), F.first("_line").alias("_line"),
    )
    heading = F.col("kind") == "SceneHeading"
    number = F.when(heading, F.regexp_extract("_line", HEADING_TEXT, 1).try_cast("int"))
    title = F.when(heading, _strip(F.regexp_extract("_line", HEADING_TEXT, 2))).otherwise(F.col("text"))
    return said.select(key, "at", "kind", "character", title.alias("text"), number.alias("scene_num"), "scene")


def scenes(parsed: DataFrame, key: str) -> DataFrame:
    """key, scene, heading, scene_num, n_blocks, n_chars, chars_before: each scene with the size of its heading and blocks, and of those before it in its key."""
    own = parsed.where("scene > 0").groupBy(key, "scene").agg(
        F.max(F.when(F.col("kind") == "SceneHeading", F.col("text"))).alias("heading"), F.max("scene_num").alias("scene_num"), F.count_if(F.col("kind") != "SceneHeading").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars")
    )
    total = running_sum(own.withColumn("_place", F.col("scene") - 1), key, "_place", F.col("n_chars"), "_to").drop("_place")
    return total.withColumn("chars_before", F.col("_to") - F.col("n_chars")).drop("_to")


def linear_times(found: DataFrame, key: str, duration: Column) -> DataFrame:
    """scenes() with start_s and end_s, in proportion to their place in the script of `duration` seconds; all 0 for a script without text."""
    total = found.groupBy(F.col(key).alias("_key")).agg(F.greatest(F.sum("n_chars"), F.lit(1)).alias("_all"))
    out = found.join(total, found[key].eqNullSafe(total["_key"]))
    share = lambda c: c / F.col("_all") * duration
    return out.withColumn("start_s", share(F.col("chars_before"))).withColumn("end_s", share(F.col("chars_before") + F.col("n_chars"))).drop("_key", "_all")
