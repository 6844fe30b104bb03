"""Report tables: ranked matches, failure report, console summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import salary_display
from ..operators.crawl_log import (failure_samples, failures_by_category, failures_by_domain,
                                   success_summary)
from ..operators.matching import row_order
from ..operators.ranking import rank_all, rank_top_k
from ..session import cut_lineage

# List prefixes shown in reports.
REPORT_LINKS = 8
SUMMARY_LINKS = 5
SUMMARY_ROLES = 3
SUMMARY_KEYWORDS = 4
REPORT_TITLE_CHARS = 80


def joined(hits: Column, empty: str = "") -> Column:
    return F.when(F.size(hits) > 0, F.array_join(hits, ", ")).otherwise(F.lit(empty))


def list_prefix(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def link_lines(links: Column, n: int = REPORT_LINKS) -> Column:
    shown = F.transform(list_prefix(links, n), lambda x: F.concat(
        F.left(x["title"], F.lit(REPORT_TITLE_CHARS)), F.lit(" — "), x["url"]))
    return F.array_join(shown, "\n")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` by score and row order in place of the order columns."""
    order = row_order(rows)
    return rank_all(rows, "score", *order).select(
        "rank", *[c for c in rows.columns if c not in order])


def page_match_report(matches: DataFrame) -> DataFrame:
    """Twelve-column report of matched pages, ranked."""
    rows = matches.select(
        "seq", F.col("total").alias("score"), "company",
        joined(F.col("role_hits")).alias("role_title_hits"),
        joined(F.col("keyword_hits")).alias("preferred_keywords"),
        joined(F.col("ops_hits")).alias("ops_finance_hits"),
        joined(F.col("tech_hits")).alias("tech_hits"),
        joined(F.col("method_hits")).alias("methodology_hits"),
        joined(F.col("exclude_hits")).alias("excluded_keywords"),
        "careers_url", "final_url", link_lines(F.col("job_links")).alias("top_job_links"))
    return _ranked(rows)


def listing_match_rows(matches: DataFrame, empty: str = "", separator: str = " - ") -> DataFrame:
    """Report columns of matched listings, not yet ranked."""
    skills = F.concat("ops_hits", "tech_hits", "method_hits")
    return matches.select(
        *row_order(matches), F.col("total").alias("score"), "company", "title",
        F.coalesce("location", F.lit("")).alias("location"),
        salary_display(F.col("salary_min"), F.col("salary_max"), separator).alias("salary"),
        "source", joined(F.col("role_hits"), empty).alias("role_matches"),
        joined(F.col("keyword_hits"), empty).alias("keyword_matches"),
        joined(skills, empty).alias("skills_matched"), F.col("url").alias("apply_link"))


def listing_match_report(matches: DataFrame, empty: str = "",
                         separator: str = " - ") -> DataFrame:
    """Eleven-column report of matched listings, ranked; ``empty`` marks a list without hits."""
    return _ranked(listing_match_rows(matches, empty, separator))


def page_summary(matches: DataFrame, k: int = 30) -> DataFrame:
    """Console table of the best pages."""
    best = rank_top_k(matches, k, F.col("total").desc(), F.col("seq").asc())
    return best.select(
        "rank", F.col("total").alias("score"), F.left("company", F.lit(34)).alias("company"),
        joined(list_prefix(F.col("role_hits"), SUMMARY_ROLES), "-").alias("roles"),
        joined(list_prefix(F.col("keyword_hits"), SUMMARY_KEYWORDS)).alias("keywords"),
        F.array_join(F.transform(list_prefix(F.col("job_links"), SUMMARY_LINKS),
                                 lambda x: F.left(x["title"], F.lit(60))), " | ").alias("links"),
        "final_url")


def listing_summary(matches: DataFrame, k: int = 10, company_chars: int = 29,
                    title_chars: int = 39, source_chars: int | None = None) -> DataFrame:
    """Console table of the best listings."""
    best = rank_top_k(matches, k, F.col("total").desc(),
                      *[F.col(c).asc() for c in row_order(matches)])
    source = F.left("source", F.lit(source_chars)) if source_chars else F.col("source")
    return best.select(
        "rank", F.col("total").alias("score"),
        F.left("company", F.lit(company_chars)).alias("company"),
        F.left("title", F.lit(title_chars)).alias("title"), source.alias("source"))


def unified_summary(matches: DataFrame, k: int = 15) -> DataFrame:
    return listing_summary(matches, k, company_chars=24, title_chars=50, source_chars=13)


def failure_report(records: DataFrame, seq: str) -> DataFrame:
    """Failure report as one long table: (section, key, detail, value).

    The log is scanned once, into a narrow table without texts and links; the sections read that.
    """
    records = cut_lineage(records.select(
        seq, "company", "careers_url", "error",
        F.left("text", F.lit(1)).alias("text")))             # whether there is one
    def part(df: DataFrame, section: str, key: Column, detail: Column, value: Column):
        return df.select(F.lit(section).alias("section"), key.alias("key"),
                         detail.alias("detail"), value.cast("double").alias("value"))
    blank = F.lit("")
    totals = success_summary(records).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("v"))
        for n in ("total", "success", "success_pct", "failure")])).alias("m"))
    samples = failure_samples(records, seq)
    return (part(totals, "summary", F.col("m.n"), blank, F.col("m.v"))
            .unionByName(part(failures_by_category(records), "category", F.col("category"),
                              blank, F.col("cnt")))
            .unionByName(part(failures_by_domain(records), "domain", F.col("domain"),
                              blank, F.col("cnt")))
            .unionByName(part(samples, "sample", F.col("category"), F.concat(
                F.col("company"), F.lit(" -> "), F.col("careers_url"), F.lit(" "),
                F.col("error")), F.col("pos"))))
