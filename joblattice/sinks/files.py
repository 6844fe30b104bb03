"""Writers. Every writer is distributed; reports with a limit are cut before the write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import salary_display
from ..functions.scoring import json_list
from ..functions.text import markdown_row
from ..operators.crawl_log import by_company
from ..operators.listings import EXPORT_LIMIT, MARKDOWN_LIMIT, export_rows, newest_first
from ..session import cut_lineage

# Head of the exported Markdown table.
MARKDOWN_HEAD = ("| Title | Company | Location | Salary | Source |",
                 "|-------|---------|----------|--------|--------|")


def _counted(listings: DataFrame, query: str | None, limit: int, filters: dict):
    """The export rows, found once, and their number (at most ``limit``)."""
    rows = cut_lineage(export_rows(listings, query, limit, **filters))
    return rows, rows.count()


def export_csv(listings: DataFrame, path: str, query: str | None = None,
               limit: int = EXPORT_LIMIT, **filters) -> int:
    """Newest active listings as CSV with a header; nothing is written when none match."""
    rows, n = _counted(listings, query, limit, filters)
    if n == 0:
        return 0
    flat = rows.orderBy(*newest_first()).withColumn("tags", json_list(F.col("tags")))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return n


def export_json(listings: DataFrame, path: str, query: str | None = None,
                limit: int = EXPORT_LIMIT, **filters) -> int:
    rows, n = _counted(listings, query, limit, filters)
    if n == 0:
        return 0
    (rows.orderBy(*newest_first()).write.mode("overwrite").option("ignoreNullFields", False)
     .json(path))
    return n


def markdown_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """One ``line`` per listing."""
    salary = salary_display(F.col("salary_min"), F.col("salary_max"), "–")
    return rows.select(*keep, markdown_row(
        F.col("title"), F.col("url"), F.col("company"), F.col("location"), salary,
        F.col("source")).alias("line"))


def export_markdown(listings: DataFrame, path: str, query: str | None = None,
                    limit: int = MARKDOWN_LIMIT, **filters) -> int:
    """Markdown table of at most ``limit`` listings in one text file."""
    rows, n = _counted(listings, query, limit, filters)
    if n == 0:
        return 0
    head = [f"# Job Listings ({n} results)", "", *MARKDOWN_HEAD]
    spark = rows.sparkSession
    top = spark.createDataFrame([(i, line) for i, line in enumerate(head)], "pos int, line string")
    # The limit bounds the file, so a single task orders and writes it.
    order = Window.orderBy(*newest_first())
    body = markdown_lines(rows.withColumn("pos", F.row_number().over(order) + len(head)), "pos")
    (top.unionByName(body).coalesce(1).sortWithinPartitions("pos").select("line")
     .write.mode("overwrite").text(path))
    return n


def write_crawl_log(records: DataFrame, path: str) -> None:
    """Crawl log in company order, one JSON record per line."""
    by_company(records).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_page_matches(matches: DataFrame, path: str) -> None:
    """Matches as nested JSON (scores and links inside), best first."""
    scores = F.struct(*[c for c in matches.columns if c.endswith(("_hits", "_score"))
                        or c == "total"])
    # The sort samples its input first; materialised rows spare a second scoring.
    nested = cut_lineage(matches.select("company", "careers_url", "final_url", "job_links",
                                        scores.alias("scores"), "total", "seq"))
    (nested.orderBy(F.col("total").desc(), F.col("seq").asc()).drop("total", "seq")
     .write.mode("overwrite").json(path))


def write_report(report: DataFrame, path: str) -> None:
    """Ranked report as CSV in rank order."""
    report.orderBy("rank").write.mode("overwrite").option("header", True).csv(path)


def write_listings(snapshot: DataFrame, path: str) -> None:
    """New snapshot folder, partitioned by source; the rebalance splits a dominant source."""
    (snapshot.hint("rebalance", "source").write.mode("errorifexists")
     .partitionBy("source").parquet(path))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
