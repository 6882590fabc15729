"""A pipeline of corpus operators: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import bpe, decontaminate, exact_dedup, near_dedup, queries, toxicity
from harrow.llm.common import drop_written, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is under the cut of the ordinal model, fitted to the labels."""
    return toxicity.reject(docs, toxicity.train(docs, queries.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id."""
    return near_dedup.dedup(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark are dropped."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and digests: the ids are decoded again, and the decoded text's digest is kept."""
    # The workers have run the other stages, so the encoder's caches are the small ones.
    return bpe.encoded(docs, *queries.vocabulary(), caches=bpe.LEAN_CACHES)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("bpe", encode),
]

#: SQL cannot fit the ordinal model or apply the merges; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = queries.documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if last is not None:
            drop_written(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
