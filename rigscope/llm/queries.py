"""The registered queries of this subpackage: thin readings of its operators over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigscope.llm import (alignment, archives, chat, decontam, hamming, langid, linededup, pieces, quality, runs, simhash,
                          tokencounts, toxicity)
from rigscope.llm.tables import read, shared_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=10, bits=64)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document's sampled pieces: how many, a hash of their ids, and whether decoding gives the text."""
    cut = pieces.segmentations(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return cut.select("doc_id", F.size("piece_ids").alias("n_pieces"),
                      F.lower(F.hex(F.xxhash64("piece_ids"))).alias("pieces_hash"),
                      F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back."""
    arc, warc = shared_path(spark, "pages-arc"), shared_path(spark, "pages-warc")
    archives.write_arc(read(spark, sf_dir, "pages"), arc)
    archives.convert(spark, arc, warc, min_bytes=0)
    records = archives.read_warc(spark, warc).where("record_type IN ('response', 'revisit')")
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each conversation's chat text."""
    text = chat.formatted(read(spark, sf_dir, "conversations"))
    return text.select("conv_id", "block", "n_messages", "n_quotes", "n_replies", "turns",
                       F.char_length("chat").alias("chat_chars"), F.md5(F.col("chat").cast("binary")).alias("chat_md5"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    cut = linededup.dedup_lines(docs.withColumn("n_lines", n_lines), removed_col="removed_lines")
    return cut.select("doc_id", "n_lines", "removed_lines", F.char_length("text").alias("kept_chars"),
                      F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=3)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document's runs; one document of ten has its tail repeated first."""
    docs = read(spark, sf_dir, "documents").withColumn("text", runs.planted(F.col("text"), F.col("doc_id")))
    return runs.digest(runs.periodic_runs(docs))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(read(spark, sf_dir, "documents"), *paths)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_quality_rules": op13_quality_rules,
}

SQL: dict[str, str] = {
    "op2_exact_top_k": hamming.op2_sql(),
    "op5_warc": archives.op5_sql(),
    "op7_chat_formatting": chat.op7_sql(),
    "op9_line_dedup": linededup.op9_sql(),
    "op13_quality_rules": quality.op13_sql(),
}
