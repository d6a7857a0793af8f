"""Queries of the training-data operators; each callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.llm import embeddings, language, leaks, lm, mixing, negatives, quality, ranked, secret_scan, simhash, substrings, tokens, warc
from crucible.llm.common import table


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_scan.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, label = F.col("vec_id"), F.col("label")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(id_ % 7 == 0, (label.cast("long") + 1) % 10).otherwise(label.cast("long")))
    return negatives.mine(vectors, anchor=id_ % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm, op2_embeddings, op3_substrings, op4_leaks, op5_warc, op6_token_counts, op7_language, op8_mixing, op9_simhash, op10_quality, op11_secrets, op12_ranked, op13_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embeddings": embeddings.SQL, "op3_substrings": substrings.SQL, "op5_warc": warc.SQL, "op8_mixing": mixing.SQL, "op12_ranked": ranked.SQL, "op13_negatives": negatives.SQL}
