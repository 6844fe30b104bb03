"""Exact and fuzzy duplicate detection against the stored listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.near_texts import near_texts
from ..functions.similarity import (allowed_indel, lcs_length_udf, length_band,
                                    score_from_indel, sorted_tokens)
from ..functions.text import dedup_hash, strip
from ..session import cut_lineage
from .compute import broadcast_if_small, compute_once, is_small

# Score from which two listings count as the same, and how much of
# the company name must occur in the stored one.
FUZZY_THRESHOLD = 85
COMPANY_PREFIX = 20

# Texts of either side that are compared at once; larger groups are split.
CELL_ROWS = 20_000
# Joint length from which the bit-parallel exact count beats a Levenshtein test.
LONG_TEXTS = 4_000


def company_key(company: Column) -> Column:
    return F.lower(F.left(strip(company), F.lit(COMPANY_PREFIX)))


def exact_duplicates(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch rows whose hash is stored."""
    return _by_hash(batch, stored, "left_semi")


def not_exact_duplicates(batch: DataFrame, stored: DataFrame) -> DataFrame:
    return _by_hash(batch, stored, "left_anti")


def full_hash() -> Column:
    """The row's hash; computed from title and company where it is absent or blank."""
    return F.coalesce(F.when(F.col("dedup_hash") != "", F.col("dedup_hash")),
                      dedup_hash(F.col("title"), F.col("company")))


def _by_hash(batch: DataFrame, stored: DataFrame, how: str) -> DataFrame:
    return (batch.withColumn("_hash", full_hash())
            .join(stored.select(full_hash().alias("_hash")), "_hash", how).drop("_hash"))


def find_fuzzy_duplicates(stored: DataFrame, title: str, company: str,
                          threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """Active stored listings similar to one given listing (a filtered scan)."""
    candidates = stored.where(
        F.col("is_active") & F.contains(F.lower("company"), company_key(F.lit(company))))
    texts = compute_once(candidates, {
        "a": sorted_tokens(F.lit(title), F.lit(company)),
        "b": sorted_tokens(F.col("title"), F.col("company"))}).where(_maybe(threshold))
    total = F.length("a") + F.length("b")
    counted = compute_once(texts, {"indel": total - 2 * lcs_length_udf()(F.col("a"), F.col("b"))})
    return (counted.where(F.col("indel") <= _allowed(threshold))
            .select("id", "title", "company", "source", "url",
                    score_from_indel(F.col("indel"), total).alias("similarity")))


def _grams(c: Column, n: int) -> Column:
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1)))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")),
                                        lambda i: F.substr(c, i, F.lit(n))))


def contained_in(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name) pairs where ``key`` is a substring of ``name``, without comparing all pairs.

    A contained key brings all its 3-grams along, so looking up its rarest one
    finds every name (keys of one or two characters are looked up whole). The blank
    key, one at most, is in every name and has no gram.
    """
    name_grams = names.select(
        "name", F.explode(F.array_distinct(F.concat(*[_grams(F.col("name"), n)
                                                      for n in (1, 2, 3)]))).alias("gram"))
    frequency = name_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    key = F.col("key")
    key_grams = keys.select("key", F.explode(
        F.when(F.length(key) >= 3, _grams(key, 3)).otherwise(F.array(key))).alias("gram"))
    rarest = (key_grams.join(frequency, "gram", "left").groupBy("key")
              .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    blank = F.broadcast(keys.where(key == "").select("key").distinct())
    return (rarest.join(name_grams, "gram")
            .where(F.contains(F.col("name"), key)).select("key", "name")
            .unionByName(names.where("name is not null").select("name").crossJoin(blank)))


@dataclass(frozen=True)
class _Sides:
    new: DataFrame          # a, key, name, band, part and cell
    old: DataFrame          # b, name, band, part and cell


def _distinct_new(batch: DataFrame) -> DataFrame:
    return batch.select(sorted_tokens(F.col("title"), F.col("company")).alias("a"),
                        company_key(F.col("company")).alias("key")).distinct()


def _texts_of(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct texts of the active listings whose company occurs in ``pairs``."""
    rows = stored.where("is_active").select("title", "company", F.lower("company").alias("name"))
    names = pairs.select("name").distinct()
    if is_small(pairs):           # else nearly every company is wanted
        rows = rows.join(F.broadcast(names), "name", "left_semi")
    return rows.select(sorted_tokens(F.col("title"), F.col("company")).alias("b"),
                       "name").distinct()


def _cells(rows: DataFrame, cell_rows: int, name: str) -> DataFrame:
    """``name, band`` of the groups and the number of cells they are split into."""
    return rows.groupBy("name", "band").agg(
        F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias(name))


def _candidate_sides(new: DataFrame, stored: DataFrame, threshold: int,
                     cell_rows: int) -> _Sides:
    """Both sides keyed so that every matching pair meets in exactly one group.

    Keys are the stored company, a length band (lengths of a matching pair differ
    by less than 28 %), and a part of the new and a cell of the stored texts where a
    group is large. The distinct texts are materialised: several joins read them. A missing
    text is similar to none.
    """
    own = length_band(F.length("a"), threshold)
    new = cut_lineage(new.where("a is not null").withColumn("band", own))
    # Read twice below: by its grams for their frequency, then for the rarest one.
    names = cut_lineage(stored.where("is_active").select(F.lower("company").alias("name"))
                        .distinct())
    pairs = cut_lineage(contained_in(new.select("key").distinct(), names))
    old = cut_lineage(_texts_of(stored, pairs).where("b is not null").withColumn(
        "band", length_band(F.length("b"), threshold)))
    near = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
    new = cut_lineage(new.join(pairs, "key").withColumn("band", F.explode(near))
                      .join(old.select("name", "band").distinct(), ["name", "band"], "left_semi"))
    sizes = cut_lineage(_cells(old, cell_rows, "cells").join(
        _cells(new, cell_rows, "parts"), ["name", "band"]))

    def placed(rows: DataFrame, text: str, split: str, own: str, other: str, copies: str):
        place = F.pmod(F.xxhash64(text), F.col(split)).cast("int")
        spread = F.explode(F.sequence(F.lit(0), F.col(copies) - 1))
        return (rows.join(broadcast_if_small(sizes), ["name", "band"])
                .withColumn(own, place).withColumn(other, spread).drop("cells", "parts"))
    return _Sides(placed(new, "a", "parts", "part", "cell", "cells"),
                  placed(old, "b", "cells", "cell", "part", "parts"))


def _allowed(threshold: int) -> Column:
    return allowed_indel(F.length("a") + F.length("b"), threshold)


def _near(sides: _Sides, threshold: int, every: bool) -> DataFrame:
    """Similar pairs (``a, key, b, name, indel``), or the ``a, key`` that are in one.

    The work follows the compared pairs, not the bytes: the number of tasks is fixed, so that
    small tables are not put together.
    """
    by = ["name", "band", "part", "cell"]
    spark = sides.new.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                8 * spark.sparkContext.defaultParallelism)
    new, old = (x.repartition(tasks, *by).groupBy(*by) for x in (sides.new, sides.old))
    schema = "a string, key string" + (", b string, name string, indel long" if every else "")
    return new.cogroup(old).applyInArrow(near_texts(threshold, every), schema)


def _within(limit: Column) -> Column:
    """Levenshtein distance of ``a`` and ``b`` is at most ``limit``."""
    bound = limit.cast("int")
    distance = F.call_function("levenshtein", F.col("a"), F.col("b"), bound)
    return (F.col("a") == F.col("b")) | ((bound > 0) & (distance >= 0))


def _maybe(threshold: int) -> Column:
    """No similar pair fails this; very long texts are left to the exact count."""
    long_texts = F.length("a") + F.length("b") > LONG_TEXTS
    return long_texts | _within(_allowed(threshold))


def fuzzy_matches(batch: DataFrame, stored: DataFrame, threshold: int = FUZZY_THRESHOLD,
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """All similar (new, stored) texts: ``a``, ``key``, ``b``, ``b_company``, ``similarity``.

    Works on distinct comparison strings; copies of a listing count once. Join
    back on (``b``, ``b_company``) for the stored rows.
    """
    sides = _candidate_sides(_distinct_new(batch), stored, threshold, cell_rows)
    total = F.length("a") + F.length("b")
    return _near(sides, threshold, True).select(
        "a", "key", "b", F.col("name").alias("b_company"),
        score_from_indel(F.col("indel"), total).alias("similarity"))


def fuzzy_keys(new: DataFrame, stored: DataFrame, threshold: int, cell_rows: int) -> DataFrame:
    """The (``a``, ``key``) of ``new`` that have at least one similar stored listing."""
    sides = _candidate_sides(new, stored, threshold, cell_rows)
    return _near(sides, threshold, False).distinct()


def tag_duplicates(batch: DataFrame, stored: DataFrame, threshold: int = FUZZY_THRESHOLD,
                   skip_unknown: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Batch rows with ``dup_kind``: ``exact``, ``fuzzy`` or NULL for a unique row.

    ``skip_unknown`` leaves listings of the placeholder company "Unknown" out of
    the fuzzy comparison.
    """
    # Small batches are sent to the store and the answers back, so neither is shuffled.
    hashes = broadcast_if_small(cut_lineage(batch.select(full_hash().alias("_hash")).distinct()))
    known = cut_lineage(stored.select(full_hash().alias("_hash")).join(hashes, "_hash", "left_semi")
                        .distinct())
    known = broadcast_if_small(known).withColumn("_exact", F.lit(True))
    marked = batch.withColumn("_hash", full_hash()).join(known, "_hash", "left")
    open_rows = marked.where(F.col("_exact").isNull())
    if skip_unknown:
        open_rows = open_rows.where(F.col("company") != "Unknown")
    # Few, narrow rows; kept, so that every reader of the tags finds them done.
    similar = cut_lineage(fuzzy_keys(_distinct_new(open_rows), stored, threshold, cell_rows))
    similar = broadcast_if_small(similar).withColumnsRenamed(
        {"a": "_a", "key": "_key"}).withColumn("_fuzzy", F.lit(True))
    keyed = marked.withColumns({"_a": sorted_tokens(F.col("title"), F.col("company")),
                                "_key": company_key(F.col("company"))})
    kind = (F.when(F.col("_exact"), F.lit("exact")).when(F.col("_fuzzy"), F.lit("fuzzy")))
    return (keyed.join(similar, ["_a", "_key"], "left").withColumn("dup_kind", kind)
            .select(*batch.columns, "dup_kind"))


def dedup_totals(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.coalesce("dup_kind", F.lit("unique")).alias("dup_kind")).agg(
        F.count(F.lit(1)).alias("cnt"))
