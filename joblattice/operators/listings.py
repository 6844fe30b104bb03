"""Search, statistics and upkeep of the listings snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Result limits of search and export, companies in the statistics.
SEARCH_LIMIT = 50
EXPORT_LIMIT = 5000
MARKDOWN_LIMIT = 200
STALE_DAYS = 30
TOP_COMPANIES = 10

# Region terms: union members, neighbours usually hired with them, and wide-open postings.
EU_TERMS = (
    "eu", "europe", "european union", "emea", "switzerland", "austria", "belgium", "bulgaria",
    "croatia", "cyprus", "czechia", "denmark", "estonia", "finland", "france", "germany",
    "greece", "hungary", "ireland", "italy", "latvia", "lithuania", "luxembourg", "malta",
    "netherlands", "poland", "portugal", "romania", "slovakia", "slovenia", "spain", "sweden",
    "worldwide", "anywhere", "global",
)


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive substring test; the needle is literal text, NULL gives false."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def any_tag_contains(tags: Column, needle: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: contains_ci(t, needle)), F.lit(False))


def is_active() -> Column:
    return F.col("is_active")


def matches_query(query: str | None) -> Column:
    """Title, description or tags contain the text; no text means no restriction."""
    if not query:
        return F.lit(True)
    return (contains_ci(F.col("title"), query) | contains_ci(F.col("description"), query)
            | any_tag_contains(F.col("tags"), query))


def matches_export_query(query: str | None) -> Column:
    """Title, company or tags contain the text."""
    if not query:
        return F.lit(True)
    return (contains_ci(F.col("title"), query) | contains_ci(F.col("company"), query)
            | any_tag_contains(F.col("tags"), query))


def from_source(source: str) -> Column:
    return F.col("source") == source


def is_remote() -> Column:
    return contains_ci(F.col("location"), "remote")


def pays_at_least(amount: int) -> Column:
    return F.col("salary_max") >= amount


def in_region(terms=EU_TERMS) -> Column:
    """A region term occurs as a word of the location."""
    pattern = r"(?iU)(?<![\p{L}\p{N}_])(" + "|".join(terms) + r")(?![\p{L}\p{N}_])"
    return F.coalesce(F.col("location").rlike(pattern), F.lit(False))


def newest_first() -> list[Column]:
    return [F.col("date_scraped").desc(), F.col("id").asc()]


def search(listings: DataFrame, query: str | None = None, source: str | None = None,
           remote_only: bool = False, salary_min: int | None = None,
           region: tuple[str, ...] | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Active listings matching every given filter, newest first."""
    tests = [is_active(), matches_query(query)]
    if source:
        tests.append(from_source(source))
    if remote_only:
        tests.append(is_remote())
    if salary_min is not None:
        tests.append(pays_at_least(salary_min))
    if region:
        tests.append(in_region(region))
    return (listings.where(reduce(lambda a, b: a & b, tests))
            .orderBy(*newest_first()).limit(limit))


def export_rows(listings: DataFrame, query: str | None = None, limit: int = EXPORT_LIMIT,
                last_days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Rows of an export: active, matching, optionally seen in the last days, newest first."""
    chosen = listings.where(is_active() & matches_export_query(query))
    if last_days is not None:
        chosen = chosen.where(seen_since(as_of, last_days))
    return chosen.orderBy(*newest_first()).limit(limit)


def seen_since(as_of: Column, days: int) -> Column:
    return F.col("date_scraped") >= as_of - F.make_interval(days=F.lit(days))


def active_count(listings: DataFrame) -> DataFrame:
    return listings.where(is_active()).agg(F.count(F.lit(1)).alias("total_active"))


def count_by(listings: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Active listings per key, largest first."""
    counts = listings.where(is_active()).groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
    ordered = counts.orderBy(F.col("cnt").desc(), F.col(key).asc())
    return ordered.limit(limit) if limit else ordered


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1)


def latest_run_per_source(runs: DataFrame) -> DataFrame:
    fields = [c for c in runs.columns if c != "source"]
    latest = F.max_by(F.struct(*fields), F.struct("started_at", "id"))
    return runs.groupBy("source").agg(latest.alias("run")).select("source", "run.*")


def stats(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Statistics bundle as (section, key, value): totals, sources, companies, latest run.

    The listings are scanned once: grouping sets count by source and by company, and the
    sections read that table of counts. The runs are scanned once as well.
    """
    counts = cut_lineage(
        listings.where(is_active()).select("source", "company")
        .groupingSets([["source"], ["company"]], "source", "company")
        .agg(F.grouping("source").alias("by_company"), F.count(F.lit(1)).alias("cnt")))

    def section(name: str, df: DataFrame, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), key.alias("key"),
                         value.cast("bigint").alias("value"))
    sources, firms = counts.where("by_company = 0"), counts.where("by_company = 1")
    top = firms.orderBy(F.col("cnt").desc(), F.col("company").asc()).limit(TOP_COMPANIES)
    total = sources.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"))
    found = latest_run(runs).select(F.explode(F.array(*[
        F.struct(F.lit(f"latest_run_{n}").alias("section"), F.col("source").alias("key"),
                 F.col(f"jobs_{n}").cast("bigint").alias("value")) for n in ("found", "new")]))
        .alias("r")).select("r.*")
    return (section("total_active", total, F.lit("all"), F.col("cnt"))
            .unionByName(section("by_source", sources, F.col("source"), F.col("cnt")))
            .unionByName(section("top_companies", top, F.col("company"), F.col("cnt")))
            .unionByName(found))


def mark_stale(listings: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    """Deactivate active listings last seen strictly before the cutoff; adds ``was_stale``."""
    stale = F.col("is_active") & (F.col("date_scraped") < as_of - F.make_interval(days=F.lit(days)))
    return (listings.withColumn("was_stale", F.coalesce(stale, F.lit(False)))
            .withColumn("is_active", F.col("is_active") & ~F.col("was_stale")))


def stale_count(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if("was_stale").alias("marked"))


def new_since(listings: DataFrame, since: Column) -> DataFrame:
    """Active listings scraped at or after a moment ("new today")."""
    return (listings.where(is_active() & (F.col("date_scraped") >= since))
            .agg(F.count(F.lit(1)).alias("new_listings")))


def top_tags(listings: DataFrame, k: int) -> DataFrame:
    counts = (listings.where(is_active()).select(F.explode("tags").alias("tag"))
              .groupBy("tag").agg(F.count(F.lit(1)).alias("cnt")))
    return counts.orderBy(F.col("cnt").desc(), F.col("tag").asc()).limit(k)


