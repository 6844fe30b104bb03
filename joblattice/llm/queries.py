"""Registered queries of the operators on training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from joblattice.llm import (bpe, conversation, embedding_dedup, exact_dedup, html_text, merkle,
                            near_dedup, packing, piece_codec, pitman_yor, quality_lm, sharding,
                            suffix_levels)
from joblattice.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op2_hilbert_shards")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 by the law ``rows``: counts at most one apart."""
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"), 16)
    return placed.selectExpr("_id AS doc_id", "size", "text_crc32", "'rows' AS law", "shard",
                             "slot", "cast(null AS int) AS grown_shard", "curve")


@query("op3_html_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).selectExpr(
        "_id AS page_id", "_url AS url", "text", "n_chars")


@query("op4_exact_dedup", """
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS len,
           regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
    FROM documents),
k AS (
    SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id
    FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
""")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under equality without white space."""
    return exact_dedup.copies(table(spark, sf_dir, "documents")).selectExpr(
        "_id AS doc_id", "keep_id", "group_size", "kept", "_sha AS text_sha256")


@query("op6_packing")
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


@query("op9_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word vocabulary."""
    return bpe.token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


@query("op8_embedding_dedup")
def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9 and above."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed(
        "_id", "vec_id")


@query("op10_quality_lm")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and decision of every document."""
    return quality_lm.classify(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "labels"), stored=True).selectExpr(
        "_id AS doc_id", "_lang AS lang", "perplexity", "threshold", "byte_perplexity",
        "byte_threshold", "reason", "kept")


@query("op1_order_minhash")
def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents")).selectExpr(
        "_id AS doc_id", "class_id", "class_size", "kept")


@query("op7_piece_codec")
def piece_codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again."""
    docs = table(spark, sf_dir, "documents")
    return piece_codec.decode(piece_codec.encode(docs)).selectExpr(
        "_id AS doc_id", "n_pieces", "ids_crc32", "crc32(cast(text AS binary)) AS text_crc32",
        "cast(char_length(text) AS long) AS n_chars", "xxhash64(text) = text_hash AS lossless")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


@query("op5_pitman_yor")
def pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; four fifths of them are trained on."""
    docs = table(spark, sf_dir, "documents")
    held = pitman_yor.held_out(F.col("doc_id"))
    model = pitman_yor.train(docs.where(~held))
    return pitman_yor.score(docs, model).select(
        F.col("_id").alias("doc_id"), pitman_yor.held_out(F.col("_id")).alias("held_out"),
        "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
        pitman_yor.perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))


@query("op13_merkle_manifest")
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and inclusion proof of every document; a third is tampered with."""
    return merkle.proofs(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


@query("op11_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    return conversation.repaired_hashes(table(spark, sf_dir, "conversations")).select(
        F.col("_conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", F.col("sha").alias("repaired_sha256"))


@query("op12_suffix_levels")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that passages of 400 bytes found elsewhere leave over."""
    return suffix_levels.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed(
        "_id", "doc_id")
