"""Token-sort similarity (0-100) and the native filters in front of it.

score = round(100 * (1 - indel / (len(a) + len(b)))) over sorted tokens, where
indel counts insertions and deletions. Two cheap bounds spare most pairs the
exact count: the L1 distance of the character counts and the Levenshtein
distance are both at most ``indel``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Characters counted by the signature, eight thermometer bits a tier each, 32 in four longs;
# "#" counts all digits and "~" every other character outside a-z and space.
SIGNATURE_CHARS = "abcdefghijklmnopqrstuvwxyz #~"


def sorted_tokens(title: Column, company: Column) -> Column:
    """Comparison string: cleaned, tokenised, sorted, joined."""
    raw = F.concat(strip(F.lower(title)), F.lit(" | "), strip(F.lower(company)))
    ascii_only = F.regexp_replace(raw, "[\\x80-\\xff]", "")
    words = F.regexp_replace(F.lower(ascii_only), r"[^\p{L}\p{N}_]", " ")
    tokens = F.filter(F.split(words, " +"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def signature(c: Column, tiers: int = 1) -> list[Column]:
    """Four longs a tier; differing bits of two signatures never exceed their indel distance.

    The first tier tells counts up to 8 apart, each further one the next 8: long texts
    have more than 8 of every common letter.
    """
    def count(ch: str) -> Column:
        if ch == "#":
            return F.length(F.regexp_replace(c, "[^0-9]", ""))
        if ch == "~":
            return F.length(F.regexp_replace(c, "[a-z 0-9]", ""))
        return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))

    counts = [count(ch) for ch in SIGNATURE_CHARS]
    words = []
    for below in range(0, 8 * tiers, 8):
        for start in range(0, len(SIGNATURE_CHARS), 8):
            word = F.lit(0).cast("bigint")
            for i, n in enumerate(counts[start:start + 8]):
                level = F.least(n if below == 0 else F.greatest(n - below, F.lit(0)), F.lit(8))
                bits = F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - F.lit(1)
                word = word.bitwiseOR(F.call_function("shiftleft", bits, F.lit(8 * i)))
            words.append(word)
    return words


def signature_distance(left: list[Column], right: list[Column]) -> Column:
    total = F.lit(0)
    for a, b in zip(left, right):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def allowed_indel(total_length: Column, threshold: int) -> Column:
    """Largest indel whose rounded score still reaches the threshold.

    The score rounds half to even, so ``threshold - 0.5`` counts only for even thresholds.
    """
    doubled = total_length * (2 * (100 - threshold) + 1)      # 200 * indel <= doubled
    if threshold % 2 == 0:
        return F.floor(doubled / 200)
    return F.ceil(doubled / 200) - 1


def length_ratio(threshold: int) -> float:
    """Shorter / longer length below which no pair reaches the threshold."""
    slack = (100 - threshold + 0.5) / 100
    return (1 - slack) / (1 + slack)


def length_band(length: Column, threshold: int) -> Column:
    """Bands such that matching lengths lie in the same or in neighbouring bands."""
    width = -math.log(length_ratio(threshold)) + 1e-9
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / width).cast("int")


def lcs_length_udf():
    """Arrow UDF: length of the longest common subsequence, bit-parallel per pair."""
    @F.pandas_udf("bigint")
    def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            masks: dict[str, int] = {}
            for i, ch in enumerate(x):
                masks[ch] = masks.get(ch, 0) | (1 << i)
            full = (1 << len(x)) - 1
            row = full
            for ch in y:
                hit = row & masks.get(ch, 0)
                row = ((row + hit) | (row - hit)) & full
            out.append(len(x) - bin(row).count("1"))
        return pd.Series(out, dtype="int64")
    return lcs_length


def score_from_indel(indel: Column, total_length: Column) -> Column:
    raw = F.lit(100.0) * (F.lit(1.0) - indel / total_length)
    return F.when(total_length == 0, 100).otherwise(F.bround(raw, 0)).cast("bigint")
