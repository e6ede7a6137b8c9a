"""Names of one entity: signatures, aliases that stand for a longer name, and the name to show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions.names import entity_key
from filmloom.scratch import written

# Words that a kind's signature leaves out.
LEFT_OUT = {
    "Character": ("MR", "MRS", "MS", "MISS", "DR", "DOCTOR", "THE"),
    "Location": ("INT", "EXT", "INTEXT", "INTERIOR", "EXTERIOR", "DAY", "NIGHT", "MORNING", "EVENING", "AFTERNOON", "DAWN", "DUSK", "LATE", "EARLY", "SAME", "CONTINUOUS", "LATER"),
    "Object": ("THE", "A", "AN"),
}
# Words that name nobody and nothing in particular, and those that don't count beside them.
GENERIC = {
    "Character": ("MAN", "WOMAN", "BOY", "GIRL", "MALE", "FEMALE", "NARRATOR", "VOICE", "VISITOR", "CLASS", "UNKNOWN", "PERSON", "SOMEONE", "SOMEBODY", "GUY", "LADY", "CHILD", "KID"),
    "Location": ("INT", "EXT", "ROOM", "HOUSE", "HOME", "HALL", "HALLWAY", "STREET", "INTERIOR", "EXTERIOR", "PLACE"),
    "Object": ("OBJECT", "THING", "ITEM", "STUFF"),
}
WEAK = ("INT", "EXT", "THE", "A", "AN")
# What lowers a name's rank: titles, voices off, times of day.
TITLES = ("DR ", "DR.", "MR ", "MR.", "MRS ", "MRS.", "MS ", "MS.")
OFF_SCREEN = r"\((?:O\.?\s*S\.?|V\.?\s*O\.?|O\.?\s*C\.?)\)"
TIMES = (" DAY", " NIGHT", " MORNING", " EVENING", " AFTERNOON", " DAWN", " DUSK")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def is_generic(key: Column, kind: str) -> Column:
    """Whether a key has no words, or only ones that name nothing in particular."""
    strong = F.filter(words(key), lambda w: ~w.isin(*WEAK))
    return (F.size(words(key)) == 0) | ((F.size(strong) > 0) & F.forall(strong, lambda w: w.isin(*GENERIC[kind])))


def signature(key: Column, kind: str) -> Column:
    """A key's words without those that the kind leaves out; for a character with several, without single letters; the key if none is left."""
    ws = F.filter(words(key), lambda w: ~w.isin(*LEFT_OUT[kind]))
    if kind == "Character":
        ws = F.when(F.size(ws) > 1, F.filter(ws, lambda w: F.length(w) > 1)).otherwise(ws)
    joined = F.array_join(ws, " ")
    return F.when(joined == "", key).otherwise(joined)


def rank(name: Column, sig: Column, kind: str) -> Column:
    """How well a name shows its entity: words and length of its signature, then its own length less what speaks against it."""
    upper = F.upper(name)
    minus = F.lit(0)
    if kind == "Character":
        minus = F.when(upper.rlike(OFF_SCREEN), 5).otherwise(0) + F.when(_any([upper.startswith(t) for t in TITLES]), 6).otherwise(0)
    elif kind == "Location":
        minus = F.when(_any([F.contains(upper, F.lit(t)) for t in TIMES]), 2).otherwise(0) + F.when(F.contains(name, F.lit("-")), 1).otherwise(0)
    return F.struct(F.size(words(sig)).alias("words"), F.length(sig).alias("length"), (F.length(name) - minus).alias("own"))


def resolve(names: DataFrame, group: str, name: str, kind: str) -> DataFrame:
    """group, name, signature, canonical, preferred, n_aliases: of each different name of a group the entity that it stands for.

    Names with the same signature are one entity. A signature that only one other of its group holds whole stands for
    that one: for characters, only a single word does; for places and things, only if the other has at most two words more.
    Generic names are left out, null names and groups likewise. preferred is the entity's name of highest rank, of equal
    ones the first in order. The different names are found once and written, as three steps read them. Holders of a signature are sought by its rarest word; those of a single word are counted, not
    paired.
    """
    rows = names.select(F.col(group).alias("g"), F.col(name).alias("name")).where("g IS NOT NULL AND name IS NOT NULL").distinct().withColumn("_key", entity_key(F.col("name")))
    rows = written(rows.where(~is_generic(F.col("_key"), kind)).withColumn("signature", signature(F.col("_key"), kind)).select("g", "name", "signature"), "names")
    sigs = rows.select("g", "signature").distinct().withColumn("_ws", F.array_distinct(words(F.col("signature"))))
    by_word = sigs.select("g", "signature", "_ws", F.explode("_ws").alias("_w"))
    if kind == "Character":
        many = by_word.where(F.size("_ws") > 1).groupBy("g", "_w").agg(F.count("*").alias("_n"), F.min("signature").alias("holder"))
        single = sigs.where(F.size("_ws") == 1).select("g", "signature", F.col("_ws")[0].alias("_w"))
        holders = single.join(many, ["g", "_w"]).where("_n = 1").select("g", "signature", "holder")
    else:
        often = by_word.groupBy("g", "_w").agg(F.count("*").alias("_n"))
        rare = by_word.join(often, ["g", "_w"]).groupBy("g", "signature").agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"), F.first("_ws").alias("_own"))
        held = rare.join(by_word.select("g", F.col("signature").alias("holder"), "_ws", "_w"), ["g", "_w"])
        held = held.where((F.col("holder") != F.col("signature")) & (F.size(F.array_except("_own", "_ws")) == 0))
        one = held.groupBy("g", "signature").agg(F.count("*").alias("_n"), F.min("holder").alias("holder"), F.first(F.size("_own")).alias("_size"))
        holders = one.where((F.col("_n") == 1) & (F.size(words(F.col("holder"))) <= F.col("_size") + 2)).select("g", "signature", "holder")
    named = rows.join(holders, ["g", "signature"], "left").withColumn("canonical", F.coalesce("holder", "signature"))
    r = rank(F.col("name"), F.col("signature"), kind)
    best = named.groupBy("g", "canonical").agg(F.min_by("name", F.struct(-r["words"], -r["length"], -r["own"], "name")).alias("preferred"), F.count("*").alias("n_aliases"))
    return named.join(best, ["g", "canonical"]).select(F.col("g").alias(group), F.col("name").alias(name), "signature", "canonical", "preferred", "n_aliases")
