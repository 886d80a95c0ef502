"""The registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import best_fit, divergence, embedding_dedup, language_id, license_scan, line_dedup, media_columns, oracles, personal_data, sharding, simhash_dedup, source_mix, token_counts, vector_codes
from cartulary.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.dedup_lines(spark, docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard_documents(spark, docs, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.token_counts(spark, docs, path, public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    media = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media_columns.media_column(F.col("text")).alias("media"))
    found = media.withColumn("found", media_columns.media_features(F.col("media")))
    return found.select("doc_id", "n_bytes", "found.payload_bytes", "found.payload_sha256", "found.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media_columns.digest(F.col("found.points")).alias("feature"), F.col("found.points").alias("points"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mix.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_dedup.near_duplicates(spark, docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language_id.identify(spark, docs)
    return known.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs)
    at = lambda name: F.get(F.col("base"), F.lit(0) if name == "first_word" else F.size("base") - 1).cast("long").alias(name)
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), at("first_word"), at("last_word"), *joined, "score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    linked = embedding_dedup.linked_vectors(spark, vectors)
    return linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vector_codes.compress(spark, vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergence.audit(spark, docs).select("lang", "source", "part", "item", "value", "rank")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find(spark, docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = personal_data.told
    return found.select("doc_id", *map(count, personal_data.KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_token_counts, op4_media_columns, op5_source_mix, op6_simhash_dedup, op7_language_id, op8_best_fit, op9_license_scan, op10_embedding_dedup, op11_vector_codes, op12_divergence, op13_personal_data)}
ORACLES: dict[str, str] = {"op11_vector_codes": oracles.lloyd(), "op12_divergence": oracles.DIVERGENCE}
