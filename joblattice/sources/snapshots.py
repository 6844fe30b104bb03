"""Stored listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Parquet scan spread over all cores by ``key``.

    A small input of few row groups would leave all text work to a few tasks; an
    input with enough splits is read as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def active_listings(listings: DataFrame) -> DataFrame:
    return listings.where("is_active")


def scorable_listings(listings: DataFrame) -> DataFrame:
    """Active listings with a title or a description."""
    return listings.where("is_active and (description is not null or title is not null)")
