"""Salary parsing and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# A salary range with optional k suffixes, and one of plain integers.
K_RANGE = r"\$?([\d,.]+)\s*[kK]?\s*[-–]\s*\$?([\d,.]+)\s*[kK]?"
INT_RANGE = r"\$?([\d,]+)\s*[-–]\s*\$?([\d,]+)"


def parse_amount(c: Column) -> Column:
    """``"$60,000"`` -> 60000; anything that is no integer -> NULL."""
    digits = strip(F.replace(F.replace(c, F.lit(",")), F.lit("$")))
    return F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint"))


def _bound(c: Column, pattern: str, group: int, to: str) -> Column:
    return F.replace(F.regexp_extract(c, pattern, group), F.lit(",")).try_cast(to)


def parse_k_range(c: Column) -> tuple[Column, Column]:
    """``"$60k - $90k"`` -> (60000, 90000).

    Any "k" in the text, or a lower bound below 1000, means thousands.
    """
    lo, hi = _bound(c, K_RANGE, 1, "double"), _bound(c, K_RANGE, 2, "double")
    factor = F.when(F.contains(F.lower(c), F.lit("k")) | (lo < 1000), 1000).otherwise(1)
    both = lo.isNotNull() & hi.isNotNull()
    return (F.when(both, lo * factor).cast("bigint"),
            F.when(both, hi * factor).cast("bigint"))


def parse_int_range(c: Column) -> tuple[Column, Column]:
    lo, hi = _bound(c, INT_RANGE, 1, "bigint"), _bound(c, INT_RANGE, 2, "bigint")
    both = lo.isNotNull() & hi.isNotNull()
    return F.when(both, lo), F.when(both, hi)


def _money(c: Column) -> Column:
    shown = F.concat(F.lit("$"), F.format_number(c, 0))
    return F.when(F.coalesce(c, F.lit(0)) != 0, shown).otherwise(F.lit("?"))


def salary_display(lo: Column, hi: Column, sep: str = " - ") -> Column:
    """``$60,000 - $90,000``; a missing or zero bound shows ``?``, both missing show blank."""
    none = (F.coalesce(lo, F.lit(0)) == 0) & (F.coalesce(hi, F.lit(0)) == 0)
    return F.when(none, F.lit("")).otherwise(F.concat(_money(lo), F.lit(sep), _money(hi)))
