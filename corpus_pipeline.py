"""A cleaning pipeline over ``documents``: five stages, each working on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomroute.llm import byte_bpe, line_dedup, positional_index, ppm_language, simhash_similar
from loomroute.llm.slices import bounded_batches
from loomroute.plans.workspace import checked_broadcast, free_name, save


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without any letter go; ``lang`` becomes the predicted language."""
    bounded_batches(spark)
    guess, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    found = ppm_language.annotate(docs, ppm_language.fit(docs), guess, score)
    return found.where(F.col(guess) != ppm_language.UNKNOWN).withColumn("lang", F.col(guess)).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go, except in the last document that holds them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike by 0.8 or more one document stays: the one with the smallest doc_id, once."""
    bounded_batches(spark)
    rows, row, group = simhash_similar.groups(docs)
    stay = free_name(rows, "_stay")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)).alias("first")
    many = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    many = save(many.select(group, F.col(f"first.{row}").alias(stay)), "stays")
    held = rows.join(checked_broadcast(many, many.count()), group, "left")
    return held.where(F.col(stay).isNull() | (F.col(stay) == F.col(row))).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. What a document holds is known by two hashes of its text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    a, b = free_name(docs, "_text_a"), free_name(docs, "_text_b")
    hashes = [F.xxhash64("text"), F.xxhash64(F.lit("text"), "text")]
    known = docs.select(F.struct(hashes[0].alias(a), hashes[1].alias(b)).alias("doc_id"), "text")
    hit = positional_index.contamination(known, items).where("n_hit > 0").select(f"doc_id.{a}", f"doc_id.{b}").distinct()
    hit = save(hit, "contaminated")
    marked = docs.withColumn(a, hashes[0]).withColumn(b, hashes[1])
    return marked.join(checked_broadcast(hit, hit.count()), [a, b], "left_anti").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document left, with digests of ids and decoded bytes."""
    bounded_batches(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", token_ids),
]

#: No stage list with trained models, similarity groups and BPE has a SQL form; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
