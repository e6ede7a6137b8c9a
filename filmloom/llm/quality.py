"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule owns the measures it needs, as an expression over the text. Its cost (the time of a job that evaluates it on a
bounded sample, rows repeated, beyond that of a job that evaluates nothing) and its selectivity (the share of the sample
that it rejects) are estimated; the rules then run in order of rejection per cost, inside one CASE that stops at the first rule that
rejects, so later measures of rejected rows are never computed. The order decides how much is computed, never what is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS, WS_RE, quoted, read_table, without_white_space

#: About so many rows make up the sample by which rules are ordered; they are repeated so often to tell what a row costs.
SAMPLE_ROWS = 400
REPEATS = 3
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once for a row, wherever the optimiser moves the expression."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS_RE), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(WS)) != "")


def _grams(ws: Column, n: int, places: bool = True) -> Column:
    """A struct (64-bit hash h, place p), or the hash alone, for each window of n words."""

    def windows(h: Column) -> Column:
        own = lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)])
        first = F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))
        return F.transform(first, (lambda x, i: F.struct(own(x, i).alias("h"), i.alias("p"))) if places else own)

    return let(F.transform(ws, lambda x: F.xxhash64(x)), windows)


def repeat_words(ws: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more.

    Windows are sorted by hash with their places; those equal to a neighbour occur again, and the union of the places
    that they cover is summed up from left to right. Nothing leaves the row.
    """

    def covered(s: Column) -> Column:
        # A window's neighbours in sorted order, side by side with it, so that no lambda looks into an array.
        h, end = s["h"], F.array(F.lit(None).cast("long"))
        beside = F.arrays_zip(s["p"].alias("p"), h.alias("h"), F.concat(end, h).alias("before"), F.concat(F.slice(h, F.lit(2), F.size(h) + 1), end).alias("after"))
        again = F.filter(beside, lambda z: z["p"].isNotNull() & (z["h"].eqNullSafe(z["before"]) | z["h"].eqNullSafe(z["after"])))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("int").alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.cast("int").alias("last"))
        return F.aggregate(F.sort_array(F.transform(again, lambda z: z["p"])), start, step, lambda acc: acc["n"])

    return let(F.sort_array(_grams(ws, 3)), covered)


def top_bigram(ws: Column) -> Column:
    """How often the most frequent window of two words occurs."""
    start = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def step(acc: Column, h: Column) -> Column:
        run = F.when(acc["h"].eqNullSafe(h), acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(h.alias("h"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(_grams(ws, 2, False)), start, step, lambda acc: acc["best"])


def _spare(ws: Column, n: int) -> Column:
    """Number of windows of n words less that of different ones."""
    return let(_grams(ws, n, False), lambda h: F.size(h) - F.size(F.array_distinct(h)))


def _without(text: Column, chars: str) -> Column:
    for ch in chars:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


class Measures:
    """What rules look at, each as an expression over a text and its words; columns that are there already can stand in."""

    def __init__(self, text: Column, ws: Column, **known: Column):
        self.text, self.words, self.known = text, ws, known

    def of(self, name: str) -> Column:
        return self.known[name] if name in self.known else MEASURES[name](self.text, self.words).cast("long")


MEASURES: Mapping[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: F.char_length(without_white_space(t)),
    "n_symbols": lambda t, w: F.char_length(t) - F.char_length(_without(t, SYMBOLS)),
    "n_dup_lines": lambda t, w: let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_breaks": lambda t, w: F.char_length(t) - F.char_length(_without(t, "\n")),
    "n_repeat_words": lambda t, w: repeat_words(w),
    "n_letter_words": lambda t, w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
    "n_digits": lambda t, w: F.char_length(t) - F.char_length(_without(t, "0123456789")),
    "n_lines": lambda t, w: F.size(lines(t)),
    "n_bullet_lines": lambda t, w: F.size(F.filter(lines(t), lambda x: x.rlike(r"\A[\x20\x09-\x0D]*[•*-]"))),
    "n_ellipsis_lines": lambda t, w: F.size(F.filter(lines(t), lambda x: x.rlike(r"(…|\.\.\.)[\x20\x09-\x0D]*\z"))),
    "n_top_bigram": lambda t, w: top_bigram(w),
    "n_spare_windows": lambda t, w: _spare(w, 3),
    "n_spare_bigrams": lambda t, w: _spare(w, 2),
}

Rule = Callable[[Measures], Column]
#: A document is rejected if one of these holds, in whole numbers. A first condition beside & is a cheap one that the second implies.
BASE_RULES: Mapping[str, Rule] = {
    "too_few_words": lambda m: m.of("n_words") < 50,
    # A window beyond the distinct ones makes at most two that occur again, of three words each; the exact measure follows only where that could be enough.
    "repeated_windows": lambda m: (600 * m.of("n_spare_windows") > 50 * m.of("n_words")) & (100 * m.of("n_repeat_words") > 50 * m.of("n_words")),
}
RULES: Mapping[str, Rule] = {
    "words_too_short": lambda m: m.of("word_chars") < 2 * m.of("n_words"),
    "words_too_long": lambda m: m.of("word_chars") > 20 * m.of("n_words"),
    "symbols": lambda m: 10 * m.of("n_symbols") > m.of("n_words"),
    "duplicate_lines": lambda m: (10 * m.of("n_breaks") > m.of("n_words")) & (10 * m.of("n_dup_lines") > m.of("n_words")),
    "words_without_letters": lambda m: 100 * m.of("n_letter_words") < 80 * m.of("n_words"),
    "digits": lambda m: 100 * m.of("n_digits") > 30 * m.of("word_chars"),
    "bullet_lines": lambda m: m.text.rlike("[•*-]") & (100 * m.of("n_bullet_lines") > 90 * m.of("n_lines")),
    "ellipsis_lines": lambda m: (m.text.contains("…") | m.text.contains("...")) & (100 * m.of("n_ellipsis_lines") > 30 * m.of("n_lines")),
    "top_bigram": lambda m: (200 * (m.of("n_spare_bigrams") + 1) > 30 * m.of("n_words")) & (200 * m.of("n_top_bigram") > 30 * m.of("n_words")),
}
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(rules: Mapping[str, Rule], order: Sequence[str], m: Measures) -> Column:
    """The name of the first rule in this order that rejects the row, else null. Rules after it are not computed."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in order:
        out = out.when(rules[name](m), name)
    return out


def rejected_by(text: Column, rules: Mapping[str, Rule], order: Sequence[str]) -> Column:
    """cascade() of a text (null counts as empty), with its words split once."""
    t = F.coalesce(text, F.lit(""))
    return let(F.struct(t.alias("t"), words(t).alias("w")), lambda x: cascade(rules, order, Measures(x["t"], x["w"])))


def order_rules(docs: DataFrame, text_col: str, rules: Mapping[str, Rule], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of rules by rejection per cost, both estimated on a bounded sample of docs."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    sample = docs.select(text.alias("t")).sample(share, seed=7).withColumn("w", words(F.col("t"))).cache()
    m = Measures(F.col("t"), F.col("w"))
    hits = sample.agg(F.count("*").alias("_rows"), *[F.sum(F.when(rule(m), 1).otherwise(0)).alias(name) for name, rule in rules.items()]).first()
    often = sample.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(rejects: Column) -> float:
        began = time.perf_counter()
        often.agg(F.sum(F.when(rejects, 1).otherwise(0))).first()
        return time.perf_counter() - began

    nothing = min(seconds(F.length("t") < 0) for _ in range(2))
    found = [(-(hits[name] or 0) / max(seconds(rule(m)) - nothing, 1e-3), name) for name, rule in rules.items()]
    sample.unpersist()
    return [name for _, name in sorted(found)]


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    A null or empty text has no words and fails the base rules. kept is false if base_failed or if a rule rejects;
    rejected_by names the rule met first (its choice among several depends on the estimated order) or is null.
    Repeated rows are judged each; an empty table gives an empty result; other columns don't matter.
    """
    order = order_rules(docs, text_col, rules, sample_rows)
    df = docs.select(F.col(quoted(id_col)).alias("_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words(F.col("_t")))
    m = Measures(F.col("_t"), F.col("_w"))
    df = df.select("_id", "_t", "_w", *[m.of(c).alias(c) for c in BASE_COLUMNS])
    m = Measures(F.col("_t"), F.col("_w"), **{c: F.col(c) for c in BASE_COLUMNS})
    base = BASE_RULES["too_few_words"](m) | (100 * m.of("n_repeat_words") > 50 * m.of("n_words"))
    df = df.select("_id", *BASE_COLUMNS, base.alias("base_failed"), F.when(base, F.lit("base")).otherwise(cascade(rules, order, m)).alias("rejected_by"))
    return df.select(F.col("_id").alias(id_col), *BASE_COLUMNS, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep_good(docs: DataFrame, text_col: str = "text", rules: Mapping[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all columns, that judge_quality keeps. Base rules are ordered among the others here."""
    rules = {**BASE_RULES, **rules}
    order = order_rules(docs, text_col, rules, sample_rows)
    return docs.where(rejected_by(F.col(quoted(text_col)), rules, order).isNull())


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge_quality(read_table(spark, sf_dir, "documents"))
    return out.drop("rejected_by")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
bi AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, two, count(*) AS n FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS two FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)) GROUP BY doc_id, two) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS letters, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits,
             len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '\A[\x20\x09-\x0D]*[•*-]'))) AS bullets,
             len(list_filter(ls, lambda x: regexp_matches(x, '(…|\.\.\.)[\x20\x09-\x0D]*\z'))) AS ellipses, coalesce(bi.n, 0) AS two
      FROM l LEFT JOIN cov ON cov.doc_id = l.doc_id LEFT JOIN bi ON bi.doc_id = l.doc_id),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             (word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR 100 * letters < 80 * n_words
              OR 100 * digits > 30 * word_chars OR 100 * bullets > 90 * n_lines OR 100 * ellipses > 30 * n_lines OR 200 * two > 30 * n_words) AS rejected FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM v
"""
