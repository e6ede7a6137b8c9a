"""Where in a track of subtitles a dialogue is spoken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions import fuzzy
from filmloom.functions.text import _bind
from filmloom.operators.ranges import over_ranges
from filmloom.scratch import written

#: Entries that are read together at most, shortest text, scores this near count as equal.
WIDTH, SHORTEST, NEAR = 3, 6, 0.015


def _joined(ws: Column) -> Column:
    return F.xxhash64(F.array_join(ws, " "))


def _grams(text: Column, n: int) -> Column:
    """Hashes of a bare text's n-word windows; of all its words if it has fewer."""
    return _bind(text, lambda ws: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - n + 1)), lambda i: _joined(F.slice(ws, i, n)))))


def _following(entries: DataFrame, key: str, place: str) -> DataFrame:
    """key, place, start_s and _next: the texts and ends of each entry and the WIDTH - 1 after it."""
    more = over_ranges(entries.select(key, place, "start_s", "end_s", "text"), key, place, 0, WIDTH - 1, lambda w: {"_next": F.array(*[F.struct(F.lead("text", k).over(w).alias("t"), F.lead("end_s", k).over(w).alias("e")) for k in range(WIDTH)])})
    return more.select(key, place, "start_s", F.filter("_next", lambda x: x["e"].isNotNull()).alias("_next"))


def _cut(following: DataFrame, key: str, place: str) -> DataFrame:
    there = F.col("_next")
    each = following.select(key, place, "start_s", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(there)), lambda n: F.struct(F.array_join(F.transform(F.slice(there, 1, n), lambda x: F.coalesce(x["t"], F.lit(""))), " ").alias("t"), F.element_at(there, n)["e"].alias("e")))).alias("_w", "_x"))
    return each.select(key, place, (F.col("_w") + 1).alias("width"), "start_s", F.col("_x.e").alias("end_s"), fuzzy.bare(F.col("_x.t")).alias("text"))


def windows(entries: DataFrame, key: str, place: str) -> DataFrame:
    """key, place, width, start_s, end_s, text (bare): 1 to WIDTH entries from each one on, joined by a blank."""
    return _cut(_following(entries, key, place), key, place)


def _begins(there: Column, n: int) -> Column:
    """Hashes of the n words from each word of the first entry on, and of each window with fewer words: what no window from an earlier entry on begins with."""

    def of(parts: Column) -> Column:
        ws, own = F.flatten(parts), F.size(parts[0])
        long = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(own, F.size(ws) - n + 1))), lambda i: _joined(F.slice(ws, i, n)))
        short = F.transform(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.flatten(F.slice(parts, 1, k))), lambda x: F.size(x) < n), _joined)
        return F.array_distinct(F.concat(long, short))

    return _bind(F.transform(there, lambda x: fuzzy.words(fuzzy.bare(x["t"]))), of)


def score(similarity: Column, query: Column, text: Column) -> Column:
    """0.55 of the similarity, 0.35 of the share of the query's words in the text, 0.1 if it holds the query whole, less up to 0.12 for another length; within 0 and 1."""
    ws, own = F.array_distinct(fuzzy.words(query)), F.array_distinct(fuzzy.words(text))
    overlap = F.size(F.array_intersect(ws, own)) / F.greatest(F.size(ws), F.lit(1))
    length = F.least(F.lit(0.12), F.abs(F.length(text) - F.length(query)) / F.greatest(F.length(query), F.lit(1)) * 0.12)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 * similarity + 0.35 * overlap + 0.10 * F.contains(text, query).cast("double") - length))


def find_anchors(queries: DataFrame, entries: DataFrame, query_id: str, key: str, place: str, prefer_end: bool = False, gram: int = 3, least: float = 0.0) -> DataFrame:
    """query_id, key, at_s, score: for each query and each track that may hold it, where it is spoken.

    queries: query_id, texts (what to search for, in order), and optionally key, lo and hi: the track and the seconds to search.
    entries: key, place (from 0 without gaps in its track), start_s, end_s, text. Windows of 1 to WIDTH entries that share
    `gram` words in a row with a text of the query are scored against it, in order of text, place and width. The first
    of the best scores gives the time: its start, or with prefer_end its end. Later ones within NEAR of that score move it to
    an earlier start, or a later end. Scores under `least` give no row. A window that shares no such words is not found; the
    tests measure how often the whole comparison, pair by pair, finds another one.
    """
    bounded = "lo" in queries.columns
    own = [F.col("lo"), F.col("hi"), F.col(key).alias("_track")] if bounded else []
    asked = queries.select(F.col(query_id).alias("_q"), *own, F.posexplode("texts").alias("_nth", "_t")).withColumn("_t", fuzzy.bare(F.col("_t"))).where(F.length("_t") >= SHORTEST)
    terms = asked.select("_q", "_nth", "_t", *[F.col(c) for c in (("lo", "hi", "_track") if bounded else ())], F.explode(_grams(fuzzy.words(F.col("_t")), gram)).alias("_g"))
    # Words that a query shares begin in one entry: only windows that hold such an entry are formed and cut into words.
    following = written(_following(entries, key, place), "entries")
    wanted = terms.select("_g").distinct()
    hits = following.select(key, place, F.explode(_begins(F.col("_next"), gram)).alias("_g")).join(wanted, "_g", "left_semi")
    holds = hits.select(F.col(key).alias("_hk"), F.explode(F.sequence(F.col(place) - (WIDTH - 1), F.col(place))).alias("_hp")).distinct()
    near = following.join(holds, (F.col(key) == F.col("_hk")) & (F.col(place) == F.col("_hp")), "left_semi")
    wins = _cut(near, key, place).where(F.length("text") >= SHORTEST)
    index = wins.select(F.col(key), F.col(place).alias("_p"), "width", "start_s", "end_s", "text", F.explode(_grams(fuzzy.words(F.col("text")), gram)).alias("_g"))
    both = index.join(terms, "_g")
    if bounded:
        both = both.where((F.col(key) == F.col("_track")) & (F.col("start_s") >= F.col("lo")) & (F.col("end_s") <= F.col("hi")))
    pairs = both.groupBy("_q", "_nth", "_t", key, "_p", "width").agg(F.first("start_s").alias("start_s"), F.first("end_s").alias("end_s"), F.first("text").alias("text"))
    if least > 0:  # lengths bound the similarity: what can reach neither `least` nor NEAR below it is not compared
        a, b = F.length("_t"), F.length("text")
        pairs = pairs.where(score(2 * F.least(a, b) / (a + b), F.col("_t"), F.col("text")) >= least - NEAR)
    scored = pairs.withColumn("_sim", fuzzy.ratio("_t", "text")).withColumn("_s", score(F.col("_sim"), F.col("_t"), F.col("text")))
    rows = written(scored.select("_q", F.col(key).alias("_k"), F.struct("_nth", "_p", "width").alias("_o"), "start_s", "end_s", "_s"), "scores", following)
    best = rows.groupBy("_q", "_k").agg(F.max("_s").alias("_best"), F.min_by("_o", F.struct(-F.col("_s"), "_o")).alias("_first"))
    near = rows.join(best, ["_q", "_k"]).where((F.col("_best") >= least) & (F.col("_best") > 0) & (F.col("_o") >= F.col("_first")) & (F.col("_s") >= F.col("_best") - NEAR))
    at = F.max("end_s") if prefer_end else F.min("start_s")
    return near.groupBy(F.col("_q").alias(query_id), F.col("_k").alias(key)).agg(at.alias("at_s"), F.first("_best").alias("score"))


def confidence(quality: Column, start: Column, end: Column, has_window: Column) -> Column:
    """How sure an alignment is: by the quality of its anchors (full, partial or other), their scores, and whether a semantic window was found."""
    n = start.isNotNull().cast("int") + end.isNotNull().cast("int")
    both, top, first = (F.coalesce(start, F.lit(0.0)) + F.coalesce(end, F.lit(0.0))) / n, F.greatest(start, end), F.coalesce(start, end)
    rounded = lambda most, base, value: F.round(F.least(F.lit(most), base + value), 3)
    out = F.when((quality == "full") & (n > 0), rounded(0.99, 0.15, both * 0.85)).when((quality == "partial") & (n > 0), rounded(0.92, 0.10, first * 0.80))
    out = out.when(has_window & (n > 0), rounded(0.55, 0.16, top * 0.45)).when(has_window, 0.30)
    return out.when(n > 0, rounded(0.35, 0.06, top * 0.35)).otherwise(0.10)
