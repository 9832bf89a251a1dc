"""The registered queries of the corpus operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, conversation_repair, conversation_trie, decontaminate, jaccard_join, langid, line_rules, maxent_lm, oracle, packing, pii, quality, secret_scan, substring_dedup
from tideline.llm.common import in_fold, read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~in_fold(F.col("label_id"), 3, 1))
    return quality.score(docs, model, held_out=in_fold(F.col("doc_id"), 3, 1))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similarity_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = maxent_lm.fit(docs.where(~in_fold(F.col("doc_id"), 5, 1)))
    return maxent_lm.score(docs, model, held_out=in_fold(F.col("doc_id"), 5, 1))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_documents(read_table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents")).drop("row")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = langid.fit(docs, ~in_fold(F.col("doc_id"), 4, 2))
    return langid.predict(docs, net, held_out=in_fold(F.col("doc_id"), 4, 2))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.opening_trie(read_table(spark, sf_dir, "conversations"), group=5, longest=9)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations)[0]


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_secrets reports of its fixed patterns alone."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_pii reports of its fixed patterns alone."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_maxent": op4_maxent,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_substrings": op7_substrings,
    "op8_rules": op8_rules,
    "op9_language": op9_language,
    "op10_decontaminate": op10_decontaminate,
    "op11_trie": op11_trie,
    "op12_repair": op12_repair,
    "op13_packing": op13_packing,
    "secrets_base": secrets_base,
    "personal_base": personal_base,
}

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": oracle.JACCARD, "op8_rules": oracle.RULES, "op10_decontaminate": oracle.DECONTAMINATE, "secrets_base": oracle.SECRETS, "personal_base": oracle.PERSONAL,
    "op11_trie": oracle.TRIE, "op12_repair": oracle.REPAIR,
}
