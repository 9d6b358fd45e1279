"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.llm import (
    balltree,
    extraction,
    katz,
    merkle,
    minhash,
    mixing,
    neighbours,
    packing,
    quality,
    sharding,
    simhash,
    substrings,
    toxicity,
)
from pagewell.llm.common import read


def op1_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = minhash.grouped(read(spark, folder, "documents"), "doc_id")
    kept = F.coalesce(F.col("doc.doc_id") == F.col("component_id"), F.lit(False))
    return groups.select("doc.doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op2_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(
        "doc_id", "text", (F.pmod(toxicity.id_crc(), F.lit(5)) == 1).alias("is_held_out")
    )
    model = katz.Model(docs, "is_held_out", "doc_id")
    return model.scored().select(
        "row.doc_id",
        "row.held_out",
        "n_tokens",
        "n_known",
        F.lit(model.totals.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return quality.judged(docs, quality.QualityRules(), "doc_id").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op4_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.packed(read(spark, folder, "documents"))
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op5_tree_scoring(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    return extraction.extracted(pages).select("page_id", "url", "text", "n_chars")


def op6_seed_extend(spark: SparkSession, folder: str) -> DataFrame:
    done = substrings.deduplicated(read(spark, folder, "documents"), "doc_id")
    return done.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op7_boosted_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held_out = F.pmod(toxicity.id_crc(), F.lit(4)) == 2
    sample = toxicity.sample_of(docs, read(spark, folder, "labels"), ~held_out)
    scores = toxicity.scored(docs, toxicity.fitted(sample), "doc_id")
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = sharding.sharded(read(spark, folder, "documents"), 40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mixed(docs).select("doc.*", "copies", "copy")


def op10_shifted_curves(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, F.col("vec_id") % 100 == 0)


def op11_ball_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op12_merkle_climb(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.Manifest(read(spark, folder, "documents")).verified()


def op13_covering_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.grouped(read(spark, folder, "documents"), "doc_id")
    return groups.select("doc.doc_id", simhash.as_hex(F.col("print")).alias("fingerprint"), "component_id")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_circulant_minhash": op1_circulant_minhash,
    "op2_katz_backoff": op2_katz_backoff,
    "op3_quality_rules": op3_quality_rules,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_tree_scoring": op5_tree_scoring,
    "op6_seed_extend": op6_seed_extend,
    "op7_boosted_toxicity": op7_boosted_toxicity,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_poisson_mixing": op9_poisson_mixing,
    "op10_shifted_curves": op10_shifted_curves,
    "op11_ball_tree_search": op11_ball_tree_search,
    "op12_merkle_climb": op12_merkle_climb,
    "op13_covering_simhash": op13_covering_simhash,
}
