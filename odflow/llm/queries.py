"""Registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm import (
    alignment,
    conversations,
    decontaminate,
    lines,
    near_duplicates,
    neighbours,
    packing,
    pii,
    quality,
    repeated_passages,
    shards,
    token_counts,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack_documents(documents, tokenizer("word_bpe_49k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    kinds = F.col("base.kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in pii.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
        pii.as_text(F.col("spans")).alias("spans"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(documents, tokenizer("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def _scored(found: DataFrame, threshold: float) -> DataFrame:
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    documents = documents.select("doc_id", "text")
    model = toxicity.fit(documents, labels.filter(~held_out()))
    found = toxicity.toxicity(documents, model).withColumn("score", F.col("toxicity.score"))
    return _scored(found, toxicity.THRESHOLD)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    documents = documents.select("doc_id", "text")
    network = quality.fit(documents, labels.filter(~held_out()))
    found = quality.quality(documents, network).withColumn("score", F.col("quality_score.score"))
    return _scored(found, 0.5)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = decontaminate.find_benchmark_words(documents.select("doc_id", "text"), benchmark)
    items = "benchmark_hits.items"
    return found.select(
        "doc_id",
        F.col("benchmark_hits.n_words").alias("n_words"),
        decontaminate.n_hit().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    cleaned = "without_shared_lines"
    return found.select(
        "doc_id",
        f"{cleaned}.n_lines",
        f"{cleaned}.n_removed",
        F.sha2(F.coalesce(f"{cleaned}.text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(
        table(spark, sf_dir, "documents"), words=3, similarity=(85, 100)
    )


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_plans(turns, present=F.col("present"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shard_documents(table(spark, sf_dir, "documents"), 8)
    grown = F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", grown)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_neighbours": op8_neighbours,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sharding": op12_sharding,
    "op13_alignment": op13_alignment,
}
