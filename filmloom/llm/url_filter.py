"""URL filter: rules by host and path, and for all other urls a block list held in a Bloom filter cascade.

The cascade's first filter holds the listed keys. Keys of the corpus that it takes for listed, but aren't, go into the
second; listed keys that the second takes for one of those go into the third; and so on until a level has no false
positive. A key of the corpus is listed just when the first level that lacks it is an even one (counted from one), so
membership is exact for every key of the corpus, without a join. The first filter's rate is |listed| / (sqrt 2 *
|others|), so that all later levels hold about as many keys as the list: the filters' size follows the list, not the
corpus, and is checked against MOST_BITS before they become literals of the plan.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, read_table

MOST_BITS = 1 << 24
#: (verdict, host, path), as given.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Blocked sites: the last three labels of a host.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

HOST_RE, PATH_RE = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, HOST_RE, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, PATH_RE, 1)


def site(host: Column) -> Column:
    """The key in the block list: the host's last three labels, or all if it has fewer."""
    return F.substring_index(host, ".", -3)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as its text, or null."""
    out = None
    for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, h + p) if out is None else out.when(fits, h + p)
    return out if out is not None else F.lit(None).cast("string")


def bits_of(key: Column, level: int, k: int, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(m)) for i in range(k)]


class Level:
    """A Bloom filter: m bits, in 64-bit words, and k hashes."""

    def __init__(self, keys: DataFrame, n: int, rate: float, level: int):
        rate = min(0.5, max(rate, 1e-12))
        self.level, self.k = level, max(1, round(-math.log2(rate)))
        self.m = 64 * math.ceil(max(1, n) * -math.log2(rate) / math.log(2) / 64)
        if self.m > MOST_BITS:
            raise ValueError(f"a filter of {self.m} bits is over the bound of {MOST_BITS}: shard the list by site and filter each shard")
        pos = keys.select(F.explode(F.array(*bits_of(F.col("key"), level, self.k, self.m))).alias("p"))
        words = pos.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("bits"))
        self.words = [0] * (self.m // 64)
        for r in words.collect():  # at most m / 64 rows
            self.words[r["w"]] = r["bits"]

    def has(self, key: Column) -> Column:
        table, out = F.lit(self.words), None
        for p in bits_of(key, self.level, self.k, self.m):
            bit = F.getbit(F.get(table, (p / 64).cast("int")), (p % 64).cast("int")) == 1
            out = bit if out is None else out & bit
        return out


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """universe, listed: distinct keys (column key), materialised. Levels for cascade_has."""
    inside = materialise(listed.join(universe, "key", "left_semi"), "listed")
    outside = materialise(universe.join(F.broadcast(inside) if inside.count() <= 10_000 else inside, "key", "left_anti"), "others")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    held, against, n = inside, outside, n_in
    while n:
        rate = n_in / (math.sqrt(2) * n_out) if not levels and n_out else 0.5
        levels.append(Level(held, n, rate, len(levels)))
        held, against = against.where(levels[-1].has(F.col("key"))), held
        if len(levels) > 1:
            held = materialise(held, f"level{len(levels)}")
        n = held.count()
    return levels


def cascade_has(key: Column, levels: Sequence[Level]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, listed: Sequence[str] = LISTED, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule (null if none fits), verdict for each row of pages.

    A null url, or one without ``://``, has an empty host and path: no rule fits and it is allowed. A rule's verdict
    comes before the list's; a site that isn't listed is allowed. Repeated rows are judged each; an empty table gives an
    empty result and other columns don't matter.
    """
    host, path = url_parts(F.col(url_col))
    own = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    universe = materialise(own.select(site(F.col("host")).alias("key")).distinct(), "sites")
    names = pages.sparkSession.range(1).select(F.explode(F.lit(sorted(set(listed)))).alias("key"))
    levels = cascade(universe, names)
    out = own.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for verdict, h, p in rules:
        by_rule = F.when(F.col("rule") == h + p, verdict).otherwise(by_rule)
    by_list = F.when(cascade_has(site(F.col("host")), levels), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, by_list).alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule,
       coalesce(m.verdict, CASE WHEN regexp_matches(array_to_string(string_split(p.host, '.')[-3:], '.'), '^(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
