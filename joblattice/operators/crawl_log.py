"""Crawl diagnostics, re-crawl selection and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.crawl import categorize, is_failure, is_success
from ..functions.urls import url_authority
from ..session import cut_lineage
from .compute import broadcast_if_small
from .ranking import first_k, previous_value

# Sizes of the failure report.
TOP_DOMAINS = 25
SAMPLES_PER_CATEGORY = 8


def successes(records: DataFrame) -> DataFrame:
    return records.where(is_success(F.col("error"), F.col("text")))


def failures(records: DataFrame) -> DataFrame:
    return records.where(is_failure(F.col("error")))


def recrawl_targets(records: DataFrame, categories=(), include_ok: bool = False) -> DataFrame:
    """Company and url of the records to visit again."""
    chosen = records if include_ok else failures(records)
    if categories:
        chosen = chosen.where(categorize(F.col("error")).isin(*categories))
    return chosen.select("company", "careers_url")


def failures_by_category(records: DataFrame) -> DataFrame:
    return (failures(records).groupBy(categorize(F.col("error")).alias("category"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col("category").asc()))


def failures_by_domain(records: DataFrame, k: int = TOP_DOMAINS) -> DataFrame:
    """Largest failing hosts; a blank host takes one of the k places and is then hidden."""
    host = url_authority(F.coalesce("careers_url", F.lit("")))
    return (failures(records).groupBy(host.alias("domain"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col("domain").asc()).limit(k)
            .where(F.col("domain") != ""))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 1), F.lit(0.0))


def success_summary(records: DataFrame) -> DataFrame:
    counts = records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_success(F.col("error"), F.col("text"))).alias("success"),
        F.count_if(is_failure(F.col("error"))).alias("failure"))
    return counts.withColumn("success_pct", _rate(F.col("success"), F.col("total")))


def error_totals(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("records"),
                       F.count_if(is_failure(F.col("error"))).alias("errors"))


def failure_samples(records: DataFrame, seq: str, k: int = SAMPLES_PER_CATEGORY) -> DataFrame:
    """Up to k failures per category in log order, with the category's size."""
    failed = failures(records).select(
        categorize(F.col("error")).alias("category"), "company", "careers_url", "error", seq)
    sizes = failed.groupBy("category").agg(F.count(F.lit(1)).alias("category_size"))
    # One row per category of a fixed list of twelve.
    return first_k(failed, ["category"], k, F.col(seq).asc()).join(
        F.broadcast(sizes), "category")


def progress_metrics(records: DataFrame, name: str | Observation = "progress") -> DataFrame:
    """Attach running totals to a job (read them from the query listener or Observation)."""
    return records.observe(name, F.count(F.lit(1)).alias("completed"),
                           F.count_if(is_failure(F.col("error"))).alias("errors"))


def progress_steps(records: DataFrame, seq: str, steps: int = 20) -> DataFrame:
    """Roll-up in log order at ``steps`` equal stretches of the sequence.

    Completed and failed records so far and the percentage done. Only the
    per-stretch counts (at most ``steps`` rows) are accumulated, never the records.
    """
    last = records.agg(F.max(seq)).first()[0] or 0
    counts = (records.groupBy(F.floor(F.col(seq) * steps / F.lit(last + 1)).alias("step"))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(is_failure(F.col("error"))).alias("e")))
    running = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    done = F.sum("n").over(running)
    return counts.select(
        "step", done.alias("completed"), F.sum("e").over(running).alias("errors"),
        F.floor(done * 100 / F.sum("n").over(Window.partitionBy())).alias("pct"))


def success_by_cycle(records: DataFrame, cycle: str = "cycle") -> DataFrame:
    """Success per crawl cycle with the gain over the cycle before."""
    per_cycle = records.groupBy(cycle).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_success(F.col("error"), F.col("text"))).alias("success"))
    order = Window.orderBy(cycle)
    return per_cycle.select(
        cycle, "total", "success", _rate(F.col("success"), F.col("total")).alias("success_pct"),
        (F.col("success") - F.lag("success").over(order)).alias("gain"))


def merge_recrawl(log: DataFrame, recrawl: DataFrame, seq: str = "seq") -> DataFrame:
    """Crawl log with re-crawled companies replaced; the last row per company wins.

    Winners are decided on (company, side, ``seq``) alone; texts and links are fetched by one
    join of the winners, so nothing wide is grouped or sorted. ``seq`` is unique on each side.
    """
    rows = (log.withColumn("_side", F.lit(0))
            .unionByName(recrawl.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    latest = rows.groupBy("company").agg(
        F.max(F.when(F.col("_side") == 1, F.col(seq))).alias("_new"),
        F.max(F.when(F.col("_side") == 0, F.col(seq))).alias("_old"))
    winners = cut_lineage(latest.select(
        F.when(F.col("_new").isNotNull(), 1).otherwise(0).alias("_side"),
        F.coalesce("_new", "_old").alias(seq)))
    return (rows.join(broadcast_if_small(winners), ["_side", seq], "left_semi")
            .select(*[c for c in rows.columns if c != "_side"]))


def recovered_count(log: DataFrame, recrawl: DataFrame, seq: str = "seq") -> DataFrame:
    """Re-crawled rows without error whose company was failing or unknown just before."""
    failed = is_failure(F.col("error")).alias("failed")
    before = (log.groupBy("company").agg(F.max_by(failed, F.col(seq)).alias("failed"))
              .select("company", F.lit(-1).cast("bigint").alias("seq"), "failed",
                      F.lit(False).alias("is_new")))
    after = recrawl.select("company", F.col(seq).cast("bigint").alias("seq"), failed,
                           F.lit(True).alias("is_new"))
    steps = previous_value(before.unionByName(after), "company", "seq", "failed", "was_failed")
    recovered = (F.col("is_new") & ~F.col("failed")
                 & F.coalesce(F.col("was_failed"), F.lit(True)))
    return steps.agg(F.count_if(recovered).alias("recovered"))


def by_company(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Stable log order: company ignoring case, then as written, then ``seq`` if there is one.

    With ``seq`` no two rows tie, so the range slices of the sort are cut by rows and one
    company may fill several.
    """
    order = [F.lower(F.coalesce("company", F.lit(""))), F.col("company")]
    return records.orderBy(*order, *([F.col(seq)] if seq in records.columns else []))
