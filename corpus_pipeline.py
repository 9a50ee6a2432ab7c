"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents.  All but the last keep the columns of `documents`, and any
others of whatever name.

Cases: null and empty texts are scored like texts without words, equal each other in exact dedup (one
row stays), are one group in near dedup, count one character in mixing and have no tokens.  Of equal
rows one stays.  A null id is preferred to no other row, is never taken out by near dedup, and is
drawn like the text "null".  An empty table gives empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import op01_exact_dedup, op03_simhash, op05_mixing, op06_toxicity, op10_bpe
from tidemark.llm._shared import staged, table
from tidemark.llm.queries import byte_bpe


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from labelled ones that are not held out."""
    return op06_toxicity.reject(docs, op06_toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return op01_exact_dedup.keep_one_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with similar shingles of five words the smallest id stays."""
    return op03_simhash.keep_one_of_each(docs, words_each=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to tempered shares, and all copies shuffled."""
    return op05_mixing.mix(docs, keys=False)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's tokens, as counts and digests of ids and of the text that they decode to."""
    return op10_bpe.Bpe(docs, byte_bpe()).digests(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]
ORACLE_SQL = None  # a trained network and fingerprints are beyond SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
