"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from visloom.llm import chat, decontaminate, exact_dedup, filter_audit, language_id, mixing, near_dup, quality, suffix_dedup, token_counts, warc, whitening, window_dedup
from visloom.storage import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest_columns(warc.resolve_revisits(warc.records_from_pages(_table(spark, sf_dir, "pages"))))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), quality.held_out()
    model = quality.fit(docs, quality.sample(quality.learning_labels(_table(spark, sf_dir, "labels"), held)))
    found = quality.scored(docs.select("doc_id", "text", held.alias("held_out")), model, threshold=0.3)
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), near_dup.Rule(k=4, num=85, den=100))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), quality.held_out("doc_id", 3, 1)
    langs, table = language_id.fit(docs.where(~held))
    found = language_id.identified(docs, langs, table)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).where("contaminated")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = written(chat.transcripts_of(_table(spark, sf_dir, "conversations")), "chat-transcripts")
    held = F.pmod(F.xxhash64("conv_id"), F.lit(5)) == 0  # another hash than the one that deals out marker styles
    model = chat.fit(raw.where(~held))
    found = chat.formatted(raw.withColumn("key", F.struct("conv_id", held.alias("held_out"), "true_roles")), model)
    return found.select("key.conv_id", "key.held_out", "n_turns", F.array_join("roles", ",").alias("roles"), F.array_join("key.true_roles", ",").alias("true_roles"), "rendered")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"), components=8)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_dedup.without_repeats(_table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_warc_revisits": op2_warc_revisits,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_mixing": op4_mixing,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_language_id": op6_language_id,
        "op7_token_counts": op7_token_counts,
        "op8_decontamination": op8_decontamination,
        "op9_chat_format": op9_chat_format,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_whitening": op11_whitening,
        "op12_window_dedup": op12_window_dedup,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": warc.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op12_window_dedup": window_dedup.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
