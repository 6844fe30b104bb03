"""First / last per key, top-k and ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Rows of one slice of a numbering; the number of slices follows from the row count.
SLICE_ROWS = 500_000


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark plans ``row_number() <= k`` with a group limit in front of the
    shuffle, so each map task sends at most one row per key and a hot key does
    not gather in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(window))
            .where(F.col("_rn") <= 1).drop("_rn"))


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return keep_first(df, keys, F.col(seq).desc())


def first_k(df: DataFrame, keys: list[str], k: int, *order: Column,
            position: str = "pos") -> DataFrame:
    """The first ``k`` rows per key with their position."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(position, F.row_number().over(window).cast("bigint"))
            .where(F.col(position) <= k))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Top-k of the whole table (per-partition heaps, then one merge of k rows each)."""
    return df.orderBy(*order).limit(k)


def rank_top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Top-k with a 1-based ``rank``; the single-task window only ever sees k rows."""
    window = Window.orderBy(*order)
    return top_k(df, k, *order).withColumn("rank", F.row_number().over(window).cast("bigint"))


def number_rows(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """Add the 1-based position ``out`` of every row in a total ``order``.

    Rows are range-sorted into slices of about ``SLICE_ROWS`` and numbered inside
    their slice; only the slice sizes are accumulated. ``order`` must end in a unique
    column: then equal scores are split over slices as well. ``df`` is materialised,
    because a range sort reads its input twice.
    """
    rows = cut_lineage(df)
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    # The number of a sorted row is its slice in the high bits, its place in the low ones.
    placed = cut_lineage(rows.repartitionByRange(slices, *order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()))
    slice_no = F.shiftright("_at", 33)
    sizes = placed.groupBy(slice_no.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_slice", slice_no).join(offsets, "_slice")
            .withColumn(out, (F.col("_off") + inside + 1).cast("bigint"))
            .drop("_slice", "_off", "_at"))


def rank_all(df: DataFrame, score: str, *tiebreak: str) -> DataFrame:
    """Add ``rank`` over all rows by ``score`` descending, then ``tiebreak`` ascending.

    The tie-break columns together are unique.
    """
    return number_rows(df, "rank", F.col(score).desc(), *[F.col(c).asc() for c in tiebreak])


def previous_value(df: DataFrame, key: str, seq: str, value: str, out: str,
                   slice_rows: int = 1_000_000) -> DataFrame:
    """``lag(value)`` per key without gathering a hot key in one task.

    Keys are cut into slices of ``seq``; the first row of a slice takes the last
    value of the key's slice before it.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(seq) / slice_rows))
    ends = sliced.groupBy(key, "_slice").agg(
        F.max_by(F.struct(F.col(value).alias("v")), seq).alias("_last"))
    carried = ends.select(key, "_slice", F.lag("_last").over(
        Window.partitionBy(key).orderBy("_slice")).alias("_carry"))
    inside = Window.partitionBy(key, "_slice").orderBy(seq)
    own = F.lag(F.struct(F.col(value).alias("v"))).over(inside)
    return (sliced.withColumn("_own", own)
            .join(carried, [key, "_slice"], "left")
            .withColumn(out, F.coalesce("_own", "_carry")["v"])
            .drop("_slice", "_own", "_carry"))
