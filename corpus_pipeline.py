"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemrec.llm import bpe, decontam, line_dedup, line_frequency, simhash
from itemrec.llm.common import named, read
from itemrec.runtime import prepare, store

#: SQL has no byte-pair merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Which ones are known by row, so that repeated ids don't mix."""
    prepare(spark)
    return line_frequency.keep(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; ``n_chars`` follows the text."""
    prepare(spark)
    found = line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*[named(c) for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    prepare(spark)
    return decontam.mark(docs, read(spark, sf_dir, "benchmark")).where("not contaminated").select(*[named(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that is left, and their digests."""
    prepare(spark)
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(coded)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("simhash", near_deduplication),
    ("decontamination", decontamination), ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before it kept, each result stored and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
