"""Profile matching of listings, crawled pages and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crawl import is_listing_link, is_success, relevant_page_links
from ..functions.scoring import Profile, combined_text, hit_lists, json_list, points
from ..functions.text import blank_to_null, strip
from .compute import compute_once
from .ranking import keep_first

# Truncations of career-page rows and their source name.
PAGE_TITLE_CHARS = 200
PAGE_TEXT_CHARS = 2000
PAGE_SOURCE = "career_page"

# Columns that order scored rows: boards before pages, then row number, then link of a page.
ROW_ORDER = ("side", "seq", "pos")

HIT_COLUMNS = ["role_hits", "keyword_hits", "ops_hits", "tech_hits", "method_hits",
               "exclude_hits"]
SCORE_COLUMNS = ["role_score", "keyword_score", "ops_score", "tech_score", "method_score",
                 "exclude_score", "total"]
LISTING_COLUMNS = ["seq", "title", "company", "url", "source", "location", "salary_min",
                   "salary_max"]


def not_excluded(profile: Profile, trim: bool = True) -> Column:
    """Company is not on the profile's exclusion list (case ignored)."""
    company = F.coalesce("company", F.lit(""))
    name = F.lower(strip(company) if trim else company)
    if not profile.exclude_companies:
        return F.lit(True)
    return ~name.isin(*[c.lower() for c in profile.exclude_companies])


def positive() -> Column:
    return F.col("total") > 0


def row_order(rows: DataFrame) -> list[str]:
    """The order columns that ``rows`` carries."""
    return [c for c in ROW_ORDER if c in rows.columns]


def listing_rows(listings: DataFrame) -> DataFrame:
    """Stored listings in scoring shape (tags as JSON text).

    Stored listings are ordered by ``id``; a batch may bring its own ``seq``.
    """
    if "seq" not in listings.columns:
        listings = listings.withColumn("seq", F.col("id"))
    return listings.select(*LISTING_COLUMNS, F.lit(0).alias("pos"), "description",
                           json_list(F.col("tags")).alias("tags_text"))


def career_page_rows(records: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per posting link of a crawled page, or one for a page without any link.

    A page whose links were all filtered away yields nothing. Both cases come out
    of one pass over the pages. Link order is kept: ``seq`` numbers pages, ``pos``
    the links of a page.
    """
    pages = records.where(is_success(F.col("error"), F.col("text")))
    links = F.coalesce("links", F.array().cast("array<struct<text:string,href:string>>"))
    placeholder = F.struct(
        F.concat(F.lit("Careers at "), F.col("company")).alias("title"),
        F.coalesce(blank_to_null(F.col("final_url")), F.col("careers_url")).alias("url"))
    postings = F.transform(
        F.filter(links, lambda x: is_listing_link(x["text"], x["href"])),
        lambda x: F.struct(F.left(strip(x["text"]), F.lit(PAGE_TITLE_CHARS)).alias("title"),
                           x["href"].alias("url")))
    entries = F.when(F.size(links) == 0, F.array(placeholder)).otherwise(postings)
    exploded = pages.select(
        F.col(seq).alias("seq"), "company",
        F.left("text", F.lit(PAGE_TEXT_CHARS)).alias("description"),
        F.posexplode(entries).alias("pos", "_entry"))
    return exploded.select(
        "seq", "_entry.title", "company", "_entry.url", F.lit(PAGE_SOURCE).alias("source"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("bigint").alias("salary_min"),
        F.lit(None).cast("bigint").alias("salary_max"), "pos", "description",
        F.lit("").alias("tags_text"))


def score_listings(rows: DataFrame, profile: Profile) -> DataFrame:
    """Add hit lists, subtotals and ``total``; roles match the title only.

    The long texts are dropped: scores are computed where the row is read, and
    no later shuffle carries a description.
    """
    text = combined_text(F.col("title"), F.col("description"), F.col("tags_text"))
    staged = rows.withColumns({"_title": F.lower(F.coalesce("title", F.lit(""))), "_text": text})
    hits = hit_lists(F.col("_title"), F.col("_text"), profile)
    return (compute_once(staged.drop("description", "tags_text"), hits).withColumns(points())
            .drop("_title", "_text"))


def score_pages(records: DataFrame, profile: Profile) -> DataFrame:
    """Add hit lists, subtotals and ``total``; every category matches the page text."""
    staged = records.withColumn("_text", F.lower("text"))
    hits = hit_lists(F.col("_text"), F.col("_text"), profile)
    return compute_once(staged.drop("text"), hits).withColumns(points()).drop("_text")


def match_listings(listings: DataFrame, profile: Profile) -> DataFrame:
    """Active listings with a positive score."""
    rows = listing_rows(listings.where(
        "is_active and (description is not null or title is not null)"))
    return score_listings(rows.where(not_excluded(profile)), profile).where(positive())


def first_seen_urls(rows: DataFrame) -> DataFrame:
    """First row per url in row order; missing urls collapse like any other value."""
    return keep_first(rows, ["url"], *[F.col(c).asc() for c in row_order(rows)])


def match_all(listings: DataFrame, pages: DataFrame | None, profile: Profile) -> DataFrame:
    """Board listings and career-page links together.

    Companies are excluded first, then the first row per url wins whatever its
    score, then positive scores stay. Scores are computed before the url step,
    on the map side, so the shuffle carries no description.
    """
    # Board rows come before page rows.
    ordered = listing_rows(listings.where("is_active")).withColumn("side", F.lit(0))
    if pages is not None:
        ordered = ordered.unionByName(career_page_rows(pages).withColumn("side", F.lit(1)))
    kept = ordered.where(not_excluded(profile))
    return first_seen_urls(score_listings(kept, profile)).where(positive())


def match_pages(records: DataFrame, profile: Profile, seq: str = "seq") -> DataFrame:
    """Crawled pages with a positive score and their relevant posting links."""
    pages = records.where(is_success(F.col("error"), F.col("text")))
    kept = pages.where(not_excluded(profile, trim=False))
    matched = score_pages(kept, profile).where(positive())
    links = relevant_page_links(
        F.coalesce("links", F.array().cast("array<struct<text:string,href:string>>")),
        profile.exclude_keywords)
    return matched.select(F.col(seq).alias("seq"), "company", "careers_url", "final_url",
                          links.alias("job_links"), *HIT_COLUMNS, *SCORE_COLUMNS)
