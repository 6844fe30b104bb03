"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups. Native.

Defined cases: a null text is empty; all texts of only white space are equal; a null id
loses every tie; a row repeated with its id is a copy of itself (one of them stays); an
empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.session import cut_lineage


def normalised(text: Column) -> Column:
    """Text without the characters space, tab, LF, VT, FF and CR; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_hash(text: Column) -> Column:
    """128-bit hash of the normalised text."""
    return F.unhex(F.md5(normalised(text)))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_id, _hash, _sha, _row, keep_id, group_size, kept``.

    Only hashes of the table are grouped; the texts of rows whose hash occurs again meet by
    (hash, text), so equal bytes are what makes a group and a hash collision does not. Of
    equal texts the row with the most code points, then the smallest id, stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = cut_lineage(docs.select(
        F.col(id_col).alias("_id"), content_hash(F.col(text_col)).alias("_hash"),
        F.sha2(normalised(F.col(text_col)), 256).alias("_sha"),
        F.monotonically_increasing_id().alias("_row")))
    repeated = cut_lineage(keys.groupBy("_hash").count().where("count > 1").select("_hash"))
    rows = cut_lineage(
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"),
                    content_hash(F.col(text_col)).alias("_hash"),
                    F.monotonically_increasing_id().alias("_row"))
        .join(repeated, "_hash", "left_semi")
        .select("_id", "_hash", "_row", normalised(F.col("_text")).alias("_norm"),
                F.char_length("_text").alias("_len"),
                F.sha2(normalised(F.col("_text")), 256).alias("_sha")))
    first = F.struct((-F.col("_len")).alias("len"), F.col("_id").isNull().alias("no_id"),
                     F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = rows.groupBy("_hash", "_norm").agg(F.min(first).alias("_first"),
                                               F.count("*").alias("group_size"))
    many = (rows.join(groups, ["_hash", "_norm"])
            .select("_id", "_hash", "_sha", "_row", F.col("_first.id").alias("keep_id"),
                    "group_size", (F.col("_row") == F.col("_first.row")).alias("kept")))
    single = (keys.join(repeated, "_hash", "left_anti")
              .select("_id", "_hash", "_sha", "_row", F.col("_id").alias("keep_id"),
                      F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))
    return single.unionByName(many)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows whose hash occurs once pass; the others meet by (hash, text).
    """
    names = docs.columns
    body = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_body")
    text = F.col("_body")[text_col]
    keyed = docs.select(body).withColumn("_hash", content_hash(text))
    repeated = cut_lineage(keyed.groupBy("_hash").count().where("count > 1").select("_hash"))
    rows = cut_lineage(keyed.join(repeated, "_hash", "left_semi")
                       .withColumn("_row", F.monotonically_increasing_id()))
    first = F.struct((-F.char_length(F.coalesce(text, F.lit("")))).alias("len"),
                     F.col("_body")[id_col].isNull().alias("no_id"),
                     F.col("_body")[id_col].alias("id"), F.col("_row").alias("row"))
    chosen = (rows.groupBy("_hash", normalised(text).alias("_norm")).agg(F.min(first).alias("f"))
              .select("_hash", F.col("f.row").alias("_row")))
    kept = rows.join(chosen, ["_hash", "_row"], "left_semi").select("_body")
    single = keyed.join(repeated, "_hash", "left_anti").select("_body")
    return single.unionByName(kept).select("_body.*")
