"""One query per operator, over whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, importance, infill, licences, lines, neardup, oracle, packing, pii, ranking, rules, secret_scan, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rules.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op7_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", {"said": said})
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        emit=bpe.emit_digest,
        emit_schema=bpe.DIGEST_SCHEMA,
    )


def op11_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chunked_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_bradley_terry": op1_bradley_terry,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_contextual_pii": op3_contextual_pii,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_weighted_minhash": op6_weighted_minhash,
    "op7_line_winnowing": op7_line_winnowing,
    "op8_pca_tiles": op8_pca_tiles,
    "op9_relational_chat": op9_relational_chat,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_layered_secrets": op11_layered_secrets,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_chunked_infill": op13_chunked_infill,
}

ORACLE_SQL = {
    "op5_quality_rules": oracle.quality_rules(),
    "op7_line_winnowing": oracle.LINE_DEDUP,
    "op9_relational_chat": oracle.CHAT,
    "op12_importance_resampling": oracle.IMPORTANCE,
    "op13_chunked_infill": oracle.FILL_IN_MIDDLE,
}
