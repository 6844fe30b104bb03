"""Company directory: filters, listing links and the coalescing upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .listings import any_tag_contains

# Policies of companies open to remote work, and the directory limit.
REMOTE_POLICIES = ("fully-remote", "remote-first")
DIRECTORY_LIMIT = 30

_TEXT_COLUMNS = ("website", "careers_url", "description", "size", "remote_policy", "source")


def is_remote_first() -> Column:
    return F.coalesce(F.col("remote_policy").isin(*REMOTE_POLICIES), F.lit(False))


def uses_tech(keyword: str) -> Column:
    return any_tag_contains(F.col("tech_stack"), keyword)


def directory(companies: DataFrame, remote_first: bool = False, tech: str | None = None,
              limit: int = DIRECTORY_LIMIT) -> DataFrame:
    chosen = companies
    if remote_first:
        chosen = chosen.where(is_remote_first())
    if tech:
        chosen = chosen.where(uses_tech(tech))
    return (chosen.select("name", "website", "remote_policy", "tech_stack", "source")
            .orderBy("name").limit(limit))


def latest_values(rows: DataFrame, key: str, seq: str, columns) -> DataFrame:
    """Latest non-NULL value of every column per key.

    ``max_by`` skips rows without an ordering value, and its partial aggregates
    collapse a hot key before the shuffle.
    """
    return rows.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def upsert_companies(stored: DataFrame, batch: DataFrame, seq: str = "seq",
                     keep_nonempty: bool = False) -> DataFrame:
    """Stored companies updated by a batch in arrival order.

    Every column takes the newest non-NULL value. The tech list is never NULL,
    so an empty incoming list replaces a full one unless ``keep_nonempty``.
    """
    tech = F.coalesce(F.col("tech_stack"), F.array().cast("array<string>"))
    if keep_nonempty:
        tech = F.when(F.size(tech) > 0, tech)
    columns = [*_TEXT_COLUMNS, "tech_stack"]
    # Stored values come before all of the batch, whatever the type of its order column.
    kind = batch.schema[seq].dataType
    old = stored.select("name", *columns, F.struct(F.lit(0).alias("side"),
                                                   F.lit(None).cast(kind).alias("at")).alias(seq))
    new = batch.select("name", *columns, F.struct(F.lit(1).alias("side"),
                                                  F.col(seq).alias("at")).alias(seq))
    rows = old.unionByName(new).withColumn("tech_stack", tech)
    merged = latest_values(rows, "name", seq, columns)
    return merged.withColumn("tech_stack", F.coalesce("tech_stack",
                                                      F.array().cast("array<string>")))


def link_companies(listings: DataFrame, companies: DataFrame) -> DataFrame:
    """Attach the known company (matched by trimmed, lower-cased name) to every listing."""
    known = companies.select(F.lower(strip(F.col("name"))).alias("_key"),
                             F.col("name").alias("company_name"),
                             F.col("remote_policy").alias("company_policy"))
    known = known.groupBy("_key").agg(F.min(F.struct("company_name", "company_policy")).alias("c"))
    keyed = listings.withColumn("_key", F.lower(strip(F.col("company"))))
    return (keyed.join(known, "_key", "left")
            .select(*listings.columns, "c.company_name", "c.company_policy"))
