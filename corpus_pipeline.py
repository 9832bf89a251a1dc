"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality classifier, n-gram Jaccard join, benchmark decontamination, secret scan, byte-level BPE.  Each
stage works on all that the one before kept, and its decisions take effect:

* quality: documents that the classifier rejects go; those without an id stay, scored like any other;
* near_duplicates: of each component of links one row stays, that with the smallest id (rows without an id
  come last, then a key of the text decides); rows without words are in no component and stay;
* decontaminate: documents with words inside benchmark windows go;
* secrets: what the scan finds is replaced by its kind in brackets, and n_chars follows the new text;
* encode: token ids of each text, with digests of ids and decoded bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, jaccard_join, quality, secret_scan
from tideline.llm.common import in_fold, read_table
from tideline.llm.queries import VOCABULARY
from tideline.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~in_fold(F.col("label_id"), 3, 1))
    rest = {c: F.col(c) for c in COLUMNS if c not in ("doc_id", "text")}
    return quality.score(docs, model, keep_text=True, **rest).where(F.col("predicted") == 1).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join; rows without words are in none and stay."""
    scratch = Scratch(spark, "near")
    found = jaccard_join.similarity_classes(docs).where(F.col("component").isNotNull())
    rows = scratch.table("rows", found.groupBy("component", "doc_id", "row").agg(F.count("*").alias("copies")))
    # only components of two rows or more; the least id first, then the least key among its rows
    ids = scratch.table("ids", rows.groupBy("component").agg(F.min("doc_id").alias("first"), F.sum("copies").alias("total")).where(F.col("total") > 1))
    near = rows.join(jaccard_join.small_side(ids), "component")
    best = near.where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("component").agg(F.min("row").alias("best"))
    least = (F.col("row") == F.col("best")) & F.col("doc_id").eqNullSafe(F.col("first"))
    marks = scratch.table("marks", near.join(best, "component").where(~least | (F.col("copies") > 1)).select(F.col("doc_id").alias("id"), F.col("row").alias("key"), least.alias("again")))
    texts = docs.select(*COLUMNS).withColumn("key_of_row", jaccard_join.row_key("doc_id", "text"))
    same = (F.col("key_of_row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    alone = texts.join(jaccard_join.small_side(marks), same, "left_anti")
    # equal rows that share id and text: one of them stays
    again = texts.join(jaccard_join.small_side(marks.where("again")), same, "left_semi").dropDuplicates(["key_of_row", "doc_id"])
    return alone.unionByName(again).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    rest = {c: F.col(c) for c in COLUMNS if c not in ("doc_id", "text")}
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), keep_text=True, **rest)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the secret scan finds taken out of their texts."""
    rest = {c: F.col(c) for c in COLUMNS if c not in ("doc_id", "text")}
    found = secret_scan.scan_documents(docs, redact=True, **rest)
    hit = F.col("spans") != ""
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(hit, F.length("redacted").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    out = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("secrets", secret_stage),
    ("encode", encode_stage),
]

#: SQL can neither train the classifier nor merge bytes by rank; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
