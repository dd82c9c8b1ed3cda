"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, jaccard_join, lm_scoring, packing, pii, quality_classifier, quality_rules, sharding, spelling, suffix_dedup, token_counts, token_store
from .sql import SQL as SQL  # noqa: PLC0414  for __spark_entry__
from .tables import documents, shared_dir

#: The pseudonyms' key of the registered queries; a real run passes its own secret.
PII_KEY = "evenhand-demo-key"


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    lengths = token_counts.token_lengths(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(documents(spark, sf_dir), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)
    return done.select(
        "doc_id",
        "text",
        F.size("pii").cast("long").alias("n_pii"),
        *(pii.count_of("pii", kind).alias(f"n_{kind}") for kind in pii.KINDS),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir)).withColumn("has_repeats", F.col("n_spans") > 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_classifier.train(docs, documents(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 6))


def op11_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(documents(spark, sf_dir), f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}", _vocabulary("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(hard_negatives.prepared(vectors.withColumn("label", moved)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_sharding, op3_pii, op4_jaccard_join, op5_packing, op6_suffix_dedup, op7_decontamination,
        op8_quality_classifier, op9_lm_scoring, op10_quality_rules, op11_token_binary, op12_hard_negatives, op13_spelling_variants, pipeline,
    )
}
