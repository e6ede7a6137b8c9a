"""Exact dedup by distributed MSD radix partitioning.

Level by level, rows are grouped by (node, next bytes of their normalised text). A group of one row is done: no other
row has its text. A group whose bytes ended before the level's width is done too: all its rows are equal. Only rows of
other groups go on, with the bytes that are left. Equality is decided by the bytes alone, never by a digest.

Each level is an algebraic count (pre-aggregated before the shuffle, so that a hot prefix costs one row a task) and a
join of the rows to the groups of two or more; both sides of it are shuffled afresh, so that AQE can split a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, materialise, quoted, read_table, without_white_space

#: Bytes that each level looks at; beyond the last, the width doubles from level to level.
WIDTHS = (64, 1024, 16384)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), widths: Sequence[int] = WIDTHS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, and the columns in carry.

    Texts are equal when identical after deleting space, tab, newline, vertical tab, form feed and carriage return; a
    null text counts as empty, and empty texts are equal to one another. Of equal texts the row with the most code
    points stays, then the smallest id; a null id comes last. Of rows that tie in both, exactly one stays. No row is
    lost or added; an empty table gives an empty result; other columns of docs don't matter. A text that is carried is
    sent once: each level takes its bytes from it. Otherwise the bytes that are left are sent alone.
    """
    normal = lambda c: F.encode(without_white_space(F.coalesce(c, F.lit(""))), "UTF-8")
    text, carried = F.col(quoted(text_col)), list(carry).index(text_col) if text_col in carry else None
    whole = None if carried is None else normal(F.col(f"_c{carried}"))
    cur = docs.select(
        F.col(quoted(id_col)).alias("_id"), *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(carry)], F.char_length(F.coalesce(text, F.lit(""))).alias("_len"), F.monotonically_increasing_id().alias("_row"),
        F.lit(0).cast("long").alias("_node"), (normal(text) if whole is None else F.lit(True)).alias("_rest"),
    )
    keep = ["_id", *[f"_c{i}" for i, _ in enumerate(carry)], "_len", "_row"]
    done, level, width, seen = [], 0, 0, 0
    while True:
        width = widths[level] if level < len(widths) else width * 2
        cur = cur.withColumn("_key", F.substring(F.col("_rest"), 1, width) if whole is None else F.substring(whole, seen + 1, width))
        groups = cur.groupBy("_node", "_key").agg(F.count("*").alias("_n")).where("_n > 1")
        groups = materialise(groups.select("_node", "_key", F.monotonically_increasing_id().alias("_group"), (F.octet_length("_key") < width).alias("_ended")), f"radix{level}")
        left = F.when(~F.col("_ended"), F.expr(f"substring(_rest, {width + 1})") if whole is None else F.lit(True))
        split = cur.join(groups.hint("merge"), ["_node", "_key"], "left").select(*keep, F.lit(level).alias("_level"), F.col("_group").alias("_node"), left.alias("_rest"))
        split = materialise(split, f"rows{level}")
        done.append(split.where("_rest is null").select(*keep, "_level", "_node"))
        last = groups.where("not _ended").isEmpty()
        drop(groups)
        if last:
            break
        cur, level, seen = split.where("_rest is not null").select(*keep, "_node", "_rest"), level + 1, seen + width
    rows = reduce(DataFrame.unionByName, done)
    # Rows 1 to n of an equal class: the best one is found by an algebraic minimum, then given to each of them.
    copies = rows.where("_node is not null")
    best = F.min(F.struct((-F.col("_len")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    classes = materialise(copies.groupBy("_level", "_node").agg(best.alias("_best"), F.count("*").alias("_n")), "classes")
    copies = copies.join(classes, ["_level", "_node"]).select(*keep, F.col("_best.id").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_best.row") == F.col("_row")).alias("kept"))
    alone = rows.where("_node is null").select(*keep, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(copies).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def keep_one_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns: one of each class of equal texts (see exact_groups)."""
    inner = docs.select(*[F.col(quoted(c)).alias(f"_x{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_x{i}" for i, c in enumerate(docs.columns)}
    out = exact_groups(inner, at[id_col], at[text_col], carry=[c for c in inner.columns if c != at[id_col]])
    return out.where("kept").select(*[F.col(at[c]).alias(c) for c in docs.columns])


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.encode(without_white_space(F.coalesce("text", F.lit(""))), "UTF-8"), 256)
    return exact_groups(docs.withColumn("text_sha256", digest), carry=["text_sha256"])


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
