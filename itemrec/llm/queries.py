"""One query for each training-data operator, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemrec.llm import bpe, chat, class_lm, decontam, jaccard, langid, line_dedup, line_frequency, merkle, oracles, quality, sharding, simhash, whitening
from itemrec.llm.common import LOWER, UPPER, id_bucket, read
from itemrec.runtime import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SHARDS = 40


@query("op1_histogram_sort", oracles.HISTOGRAM_SORT)
def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return found.select(
        "doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_class_ngrams")
def op2_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 5) == 1
    model, cold = class_lm.fit(docs, ~held_out)
    found = class_lm.score(docs, model, cold)
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity",
    )


@query("op3_neighbour_votes")
def op3_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    found = quality.predict(docs, model, "text", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: A conversation whose texts hold the marks of a template, beside those of the table.
MARKED = "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"


@query("op4_chat_windows", oracles.CHAT_WINDOWS)
def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(MARKED))
    return chat.read_back(chat.windows(turns))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@query("op6_line_dedup", oracles.LINE_DEDUP)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_naive_bayes")
def op7_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    found = langid.predict(docs, langid.fit(docs, learn=~held_out), "text", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_decontamination", oracles.DECONTAMINATION)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.mark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.items_digest(F.col("item_ids")).alias("items_sha256"), "contaminated")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op10_quality_rules", oracles.QUALITY_RULES)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.score(read(spark, sf_dir, "documents"))


@query("op11_chebyshev_whitening")
def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


@query("op12_jaccard_join")
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", oracles.MERKLE_MANIFEST)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", UPPER, LOWER)
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=id_bucket(F.col("doc_id"), 3) == 0, changes={"text": lowered})
