"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presetlake.llm import bpe, compression, langid, licenses, linechunks, packing, quality, sharding, simhash, topk
from presetlake.llm.common import spread, store, table

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Ids and texts of the whole table, for operators that spend far more on a text than its shuffle costs."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linechunks.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", F.col("new_text").alias("text"), "n_lines", "n_removed")


def op4_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir, "lang"))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return compression.score(docs, compression.fit(docs, table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(store(docs.select("doc_id", quality.measures(docs).alias("m"))))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def base_quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 measures before it judges, for which there is SQL."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality.measures(docs).alias("m")).select("doc_id", *(f"m.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), quality.base_failed().alias("base_failed"))


def base_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that the phrases alone decide, for which there is SQL."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and words of each document in the bins of op1, for which there is SQL."""
    return op1_best_fit_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("parts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_simhash_near_dedup, op3_line_dedup, op4_byte_bpe, op5_language_id,
        op6_compression_quality, op7_license_scan, op8_quality_rules, op9_exact_top_k, op10_sharding,
        base_quality_measures, base_license_phrases, packed_words,
    )
}


def oracle_sql() -> dict[str, str]:
    owner = json.dumps(sharding.fill(SHARDS))
    key = "coalesce(doc_id::VARCHAR, text, '')"
    return {
        "op3_line_dedup": linechunks.ORACLE_SQL,
        "op9_exact_top_k": topk.ORACLE_SQL,
        "base_quality_measures": quality.BASE_SQL,
        "base_license_phrases": licenses.BASE_SQL,
        "packed_words": packing.WORDS_SQL,
        "op10_sharding": f"""
WITH placed AS (
  SELECT doc_id, (('0x' || substr(md5({key}), 1, 15))::BIGINT % {sharding.SLOTS})::INTEGER AS slot FROM documents),
owner AS (SELECT {owner}::INTEGER[] AS shards)
SELECT doc_id, slot, 'shard-' || lpad(shards[slot + 1]::VARCHAR, 3, '0') AS shard FROM placed, owner
""",
    }
