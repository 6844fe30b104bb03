"""Composed jobs: ingest, crawl acceptance, diagnostics, re-crawl, matching, dedup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.crawl import (best_jobs_url, choose_text, drop_noise_links, error_message,
                               min_chars, status_error_label)
from ..functions.scoring import Profile
from ..functions.text import clean_text
from ..functions.urls import canonical_board_url
from ..operators.companies import upsert_companies
from ..operators.compute import compute_once
from ..operators.crawl_log import (by_company, merge_recrawl, recovered_count, recrawl_targets,
                                   success_summary)
from ..operators.dedup import FUZZY_THRESHOLD, dedup_totals, tag_duplicates
from ..operators.matching import match_all, match_listings, match_pages
from ..operators.merge import UpsertResult, run_counts, run_log, upsert_listings
from ..operators.ranking import number_rows
from ..sinks.reports import failure_report, listing_match_report, page_match_report
from ..session import cut_lineage
from ..sources.directories import union_directories


@dataclass(frozen=True)
class Ingest:
    """Outcome of an ingest: merged snapshot and one run row per feed."""

    result: UpsertResult
    runs: DataFrame


_RUN_START = "id long, source string, started_at timestamp"
_RUN_END = ("id long, finished_at timestamp, jobs_found long, jobs_new long, status string, "
            "error_message string")


def _utc() -> datetime:
    return datetime.now(timezone.utc)


def ingest_feeds(stored: DataFrame, feeds: dict[str, Callable[[], DataFrame]],
                 first_run: int = 1, clock: Callable[[], datetime] = _utc) -> Ingest:
    """Merge all feeds into the stored listings; a failing feed leaves the others alone.

    ``feeds`` maps a feed's name to the reader of its batch (with ``seq`` and
    ``date_scraped``). Every feed is a run of the run log, whatever source its rows name: it
    starts when it is read, and is finished as completed, if empty with zero rows, or as
    failed with the fault's message, however late that shows; then none of its rows are
    merged. If all fail, the store stays as it is. Where a feed is ordered by ``seq`` and
    ``pos``, all rows are numbered anew, feeds in the given order. Runs are numbered from
    ``first_run``.
    """
    spark = stored.sparkSession
    good, starts, ends, read_runs = [], [], [], []
    for run, (name, read) in enumerate(feeds.items(), first_run):
        starts.append((run, name, clock()))
        try:
            # Staged here, so that a fault while parsing belongs to this feed as well.
            good.append(cut_lineage(read()).withColumn("feed", F.lit(run).cast("bigint")))
            read_runs.append((run,))
        except Exception as exc:              # any reader error belongs to this feed alone
            ends.append((run, clock(), 0, 0, "failed", str(exc).split("\n")[0]))
    started = spark.createDataFrame(starts, _RUN_START)
    ended = spark.createDataFrame(ends, _RUN_END)
    if not good:
        none = spark.createDataFrame([], "seq long, source string, feed long, label string")
        return Ingest(UpsertResult(stored, none), run_log(started, ended))
    paged = any("pos" in rows.columns for rows in good)
    batch = good[0]
    for other in good[1:]:
        batch = batch.unionByName(other, allowMissingColumns=True)
    if paged:
        batch = (number_rows(batch, "_n", F.col("feed"), F.col("seq"), F.col("pos"))
                 .withColumn("seq", F.col("_n")).drop("_n", "pos"))
    result = upsert_listings(stored, batch)
    counts = run_counts(result.labels, "feed").withColumnRenamed("feed", "id")
    zero = F.lit(0).cast("bigint")
    # A handful of rows, one a feed.
    done = spark.createDataFrame(read_runs, "id long").join(counts, "id", "left").select(
        "id", F.lit(clock()).alias("finished_at"), F.coalesce("jobs_found", zero).alias("jobs_found"),
        F.coalesce("jobs_new", zero).alias("jobs_new"), F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("error_message"))
    return Ingest(result, run_log(started, done.unionByName(ended)))


def ingest_directories(stored: DataFrame, profile_files: DataFrame, table: DataFrame,
                       listed: DataFrame, seq: str = "seq") -> DataFrame:
    """Merge three company directories in load order into the stored companies."""
    rows = union_directories(profile_files, table, listed)
    # Later directories follow earlier ones; inside a directory the given order holds.
    order = F.struct("source_rank", seq)
    return upsert_companies(stored, rows.withColumn("_seq", order), seq="_seq")


def accept_pages(pages: DataFrame) -> DataFrame:
    """Stored pages (seq, company, careers_url, final_url, status, html) -> crawl records.

    A page with too little text becomes an error record; links of accepted pages
    are absolute and free of noise.
    """
    texts = pages.withColumn("_full", clean_text(H.visible_text(F.col("html"))))
    # The second pass over the html runs only where the first left too little.
    texts = texts.withColumn("_light", F.when(F.length("_full") < 200,
                                              clean_text(H.light_text(F.col("html")))))
    chosen = texts.withColumn("_text", choose_text(F.col("_full"), F.col("_light"),
                                                   F.col("status")))
    ok = F.length("_text") >= min_chars(F.col("status"), F.col("final_url"))
    error = error_message(F.coalesce(status_error_label(F.col("status")),
                                     F.lit("insufficient_content")))
    links = drop_noise_links(H.page_links(H.anchors(F.col("html")), F.col("final_url")))
    none = F.array().cast("array<struct<text:string,href:string>>")
    records = compute_once(chosen, {
        "error": F.when(~ok, error), "text": F.when(ok, F.col("_text")),
        "links": F.when(ok, links).otherwise(none)})
    given = ["scraped_at"] if "scraped_at" in pages.columns else []
    return records.select("seq", "company", "careers_url", "final_url", *given, "error", "text",
                          "links")


def next_pages(pages: DataFrame) -> DataFrame:
    """Next url to visit per stored page: canonical board, else the best jobs link."""
    anchors = pages.withColumns({"_a": H.anchors(F.col("html")), "_f": H.frames(F.col("html"))})
    found = best_jobs_url(F.col("_f"), F.col("_a"), F.col("final_url"))
    located = anchors.select("seq", "company", "final_url", found.alias("jobs_url"))
    return located.withColumn("next_url", F.coalesce(
        canonical_board_url(F.col("jobs_url")), F.col("jobs_url"),
        canonical_board_url(F.col("final_url"))))


def diagnose(records: DataFrame, seq: str = "seq") -> DataFrame:
    return failure_report(records, seq)


@dataclass(frozen=True)
class Recrawl:
    """Outcome of a re-crawl cycle."""

    targets: DataFrame
    merged: DataFrame
    recovered: DataFrame
    summary: DataFrame


def reconcile(log: DataFrame, recrawl: DataFrame, categories=(), seq: str = "seq") -> Recrawl:
    merged = merge_recrawl(log, recrawl, seq)
    return Recrawl(recrawl_targets(log, categories), by_company(merged),
                   recovered_count(log, recrawl, seq), success_summary(merged))


def page_matching(records: DataFrame, profile: Profile) -> DataFrame:
    return page_match_report(match_pages(records, profile))


def listing_matching(listings: DataFrame, profile: Profile) -> DataFrame:
    return listing_match_report(match_listings(listings, profile), empty="—", separator=" – ")


def unified_matching(listings: DataFrame, pages: DataFrame | None, profile: Profile) -> DataFrame:
    """Flagship: boards and career pages, one ranked report."""
    return listing_match_report(match_all(listings, pages, profile))


def split_duplicates(batch: DataFrame, stored: DataFrame,
                     threshold: int = FUZZY_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unique rows, duplicate rows, totals) of a batch."""
    tagged = tag_duplicates(batch, stored, threshold)
    return (tagged.where(F.col("dup_kind").isNull()), tagged.where(F.col("dup_kind").isNotNull()),
            dedup_totals(tagged))
