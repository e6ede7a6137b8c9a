"""A corpus from raw documents to packed sequences, in stages that each start from the last one's written table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession

from filmloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from filmloom.llm._common import drop_path, materialise, read_table, scratch_made

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables that the last stage's result reads. That result is written before the next stage starts.
_left: set[str] = set()


def stage(f: Stage) -> Stage:
    """A stage starts by deleting what the one before left; its own tables stay, as its result may read them."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            drop_path(spark, _left.pop())
        with scratch_made() as made:
            out = f(spark, docs, sf_dir)
        _left.update(made)
        return out

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Those with a null, empty or short text go; repeated rows are judged each."""
    return quality.keep_good(docs)


@stage
def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts equal but for white space: the longest, then the smallest id, null last. Null texts are empty ones; of rows that tie in all, one stays."""
    return exact_dedup.keep_one_of_equal(docs)


@stage
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more: the smallest id, null last. Texts without words all stay; of rows that tie in all, one stays."""
    return ngram_join.keep_one_of_linked(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. A null source is a source; texts without words are not taken."""
    return mixing.take_mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences. A null text is one end token; long texts are cut; repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Each stage takes an empty table, and columns of any names beside doc_id, text and source.
STAGES = [("quality_rules", keep_good), ("exact_dedup", drop_equal), ("ngram_jaccard_join", drop_near), ("mixing", mix_sources), ("best_fit_packing", pack_sequences)]

#: Tokenization has no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    first = read_table(spark, sf_dir, "documents")
    docs = reduce(lambda d, s: materialise(s[1](spark, d, sf_dir), s[0]), STAGES[:-1], first)
    return STAGES[-1][1](spark, docs, sf_dir)
