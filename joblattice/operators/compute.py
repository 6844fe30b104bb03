"""Compute expensive columns exactly once; broadcast only what was counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Largest number of rows, and of bytes in their columns, that is broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table has few rows and few bytes (text lengths are summed)."""
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    fixed = 16 * len(df.columns)
    n, held = df.agg(F.count(F.lit(1)), sum(text, F.lit(0))).first()
    return n <= rows and held + n * fixed <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A materialised table, marked for broadcast if its rows and bytes are few."""
    return F.broadcast(df) if is_small(df) else df


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions that later filters refer to.

    The optimizer pushes a filter below a projection by copying the projected
    expression into it, so a text score would be computed for the filter and
    again for the output. A generator is not copied: the columns come out of a
    one-element ``explode`` and every later reference reads the value.
    """
    value = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return (df.select(*kept, F.explode(F.array(value)).alias("_once"))
            .select(*kept, *[F.col("_once")[name].alias(name) for name in columns]))
