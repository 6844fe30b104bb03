"""From raw documents to packed training sequences, in stages that each read the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from joblattice.llm import exact_dedup, near_dedup, packing, quality_lm
from joblattice.session import cut_lineage

#: SQL cannot express perplexity, sketches or packing; the tests use a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not too high."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_lm.train(docs, labels).keep(docs, stored=True)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.drop_near(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences of at most 2048 tokens."""
    return packing.pack(docs).withColumnRenamed("_id", "doc_id")


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_exact),
          ("order minhash near-dedup", drop_near), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
