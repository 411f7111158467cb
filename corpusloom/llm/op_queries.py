"""The queries over whole tables, one per operator, each returning one row per document (or
conversation)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, decontamination, jaccard, merkle, periods, pii, ppm, repair, secrets, substrings, suffixes, toxicity
from corpusloom.llm.store import only, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    learn = toxicity.trained_rows(F.col("doc_id"))
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), learn))
    return scored.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_attack(table(spark, sf_dir, "conversations"))))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", *bpe.digests(F.col("ids"), F.col("decoded")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(only(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("component")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(only(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("kept_text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(only(table(spark, sf_dir, "documents"), "doc_id", "text")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op10_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ppm.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.detect_runs(periods.with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.summarise(repair.repair(repair.damaged(conversations)), conversations)


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_fingerprint": op2_fingerprint, "op3_toxicity": op3_toxicity, "op4_chat_format": op4_chat_format, "op5_byte_bpe": op5_byte_bpe, "op6_jaccard_join": op6_jaccard_join, "op7_substring_dedup": op7_substring_dedup, "op8_secret_scan": op8_secret_scan, "op9_personal_data": op9_personal_data, "op10_ppm_score": op10_ppm_score, "op11_suffix_dedup": op11_suffix_dedup, "op12_periodic_runs": op12_periodic_runs, "op13_repair_conversations": op13_repair_conversations}
