"""Hilbert-curve order of several metadata dimensions, cut into shards of equal row count.

Rows next to each other on the curve are near in every dimension, so the files of a shard
carry narrow value ranges of all of them and a reader can skip files by any of them.

Defined cases: null in a dimension takes the lowest cell; ties on the curve are ordered by
text checksum, then id, so copies lie together; an empty table gives no rows; repeated rows
are rows of their own; the output has only the named columns, so no name can clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import prepare, with_position
from joblattice.session import cut_lineage

#: Cells of one dimension are numbered with this many bits.
BITS = 8


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates (rows of ``cells``).

    The axes are turned into the transposed index bit plane by bit plane, from the highest
    (Skilling 2004), on whole columns at once; the bits are then interleaved.
    """
    axes = [c.astype(np.int64) for c in cells.T]
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (axes[i] & bit) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(flip, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    out = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for a in axes:
            out = (out << 1) | (((a ^ turn) >> level) & 1)
    return out


def category_cell(value: Column, bits: int = BITS) -> Column:
    """Cell of a category by its hash; null is cell 0."""
    return F.when(value.isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(value), F.lit(1 << bits))).cast("int")


def quantile_cuts(df: DataFrame, column: str, bits: int = BITS) -> list[float]:
    """At most 2^bits - 1 distinct cut points of a numeric column over all rows."""
    n = 1 << bits
    cuts = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000)).first()[0]
    return sorted(set(cuts or []))


def curve_of(cuts: list[float]):
    """Column function: curve index of (cell, cell, number quantised by ``cuts``)."""
    edges = np.array(cuts, dtype=float)

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, value: pd.Series) -> pd.Series:
        cell = np.searchsorted(edges, value.to_numpy(dtype=float), side="left")
        return pd.Series(hilbert_index(np.stack([a, b, cell], axis=1)))
    return curve


def hilbert_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id",
                   text_col: str = "text", category_cols: tuple[str, str] = ("source", "lang"),
                   ) -> DataFrame:
    """Shard and place of every row by (source, language, size), row counts at most one apart.

    Returns ``_id, size, text_crc32, curve, shard, slot``. Texts are read once to narrow
    rows; the order is a range sort whose last keys are checksum and id, so a hot source or
    a large group of copies is spread like anything else. Run r of n rows goes to shard
    ``floor(r * shards / n)``; ``slot`` is the place inside the shard.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        category_cell(F.col(category_cols[0])).alias("_a"),
        category_cell(F.col(category_cols[1])).alias("_b")))
    cuts = quantile_cuts(rows, "size")
    rows = cut_lineage(rows.select("_id", "size", "text_crc32",
                                   curve_of(cuts)("_a", "_b", "size").alias("curve")))
    total = rows.count()
    placed = with_position(rows, [F.col("curve"), F.col("text_crc32"), F.col("_id")])
    placed = placed.withColumn("shard", F.expr(
        f"cast((cast(pos as decimal(38,0)) * {shards}) div {max(total, 1)} as int)"))
    start = F.expr(f"(cast(shard as decimal(38,0)) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("slot", (F.col("pos") - start.cast("long"))).drop("pos")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder a shard, rows in curve order (ids must be unique)."""
    joined = docs.join(placed.select(F.col("_id").alias(id_col), "shard", "slot"), id_col)
    (joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .drop("slot").write.partitionBy("shard").parquet(path))
