"""JSON feeds -> listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_as_utc, iso_keep_offset
from ..functions.money import parse_amount, parse_k_range
from ..functions.text import append_if_absent, blank_to_null, dedup_hash, split_list, strip
from ..functions.urls import absolutize
from ..operators.compute import compute_once

# Source names and site addresses of the two feeds.
ARRAY_FEED = ("remoteok", "https://remoteok.com")
OBJECT_FEED = ("remotive", "https://remotive.com")

_ENTRY = "map<string,string>"


def _tag_list(raw: Column) -> Column:
    """A tag field that is a JSON list or a comma-separated string."""
    as_list = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    is_list = F.ltrim(raw).startswith("[")
    return F.when(is_list, as_list).otherwise(split_list(raw))


def _finish(df: DataFrame) -> DataFrame:
    """Add the derived and defaulted listing columns."""
    return df.withColumns({
        "salary_currency": F.lit("USD"),
        "experience_level": F.lit(None).cast("string"),
        "dedup_hash": dedup_hash(F.col("title"), F.col("company")),
    })


def parse_array_feed(payloads: DataFrame, payload: str = "payload",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Feed whose payload is a JSON array with a metadata element in front.

    Fewer than two elements, or no array, give no rows. An explicit null title,
    company or location drops the entry; an absent one takes its default.
    """
    source, base = ARRAY_FEED
    elements = F.from_json(F.col(payload), "array<string>")
    entries = (payloads.select(*keep, F.posexplode(elements).alias("pos", "raw_data"))
               .where(F.col("pos") > 0))
    entries = compute_once(entries, {"e": F.from_json("raw_data", _ENTRY)})

    def field(name: str) -> Column:
        return F.try_element_at(F.col("e"), F.lit(name))

    def null_given(name: str) -> Column:
        return F.map_contains_key("e", name) & field(name).isNull()

    def text(name: str) -> Column:
        return F.coalesce(field(name), F.lit(""))

    dropped = null_given("position") | null_given("company") | null_given("location")
    title, company = strip(text("position")), strip(text("company"))
    rows = entries.where(F.col("e").isNotNull() & ~dropped & (title != "") & (company != ""))
    no_tags = F.array().cast("array<string>")
    tags = (F.when(~F.map_contains_key("e", "tags"), no_tags).otherwise(_tag_list(field("tags"))))
    return _finish(rows.select(
        *keep, F.col("pos").cast("bigint").alias("pos"),
        text("id").alias("external_id"), F.lit(source).alias("source"),
        title.alias("title"), company.alias("company"), field("company_logo").alias("company_url"),
        F.when(null_given("description"), F.lit(None)).otherwise(text("description"))
        .alias("description"),
        absolutize(text("url"), base).alias("url"),
        F.coalesce(blank_to_null(strip(text("location"))), F.lit("Remote")).alias("location"),
        parse_amount(field("salary_min")).alias("salary_min"),
        parse_amount(field("salary_max")).alias("salary_max"),
        tags.alias("tags"), F.lit(None).cast("string").alias("job_type"),
        iso_keep_offset(field("date")).alias("date_posted"), "raw_data"))


def parse_object_feed(payloads: DataFrame, payload: str = "payload",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """Feed whose payload is ``{"jobs": [...]}``."""
    source, _ = OBJECT_FEED
    jobs = F.from_json(F.col(payload), "struct<jobs:array<string>>")["jobs"]
    entries = payloads.select(*keep, F.posexplode(jobs).alias("pos", "raw_data"))
    entries = compute_once(entries, {"e": F.from_json("raw_data", _ENTRY)})

    def field(name: str) -> Column:
        return F.try_element_at(F.col("e"), F.lit(name))

    def text(name: str) -> Column:
        return strip(F.coalesce(field(name), F.lit("")))

    rows = entries.where((text("title") != "") & (text("company_name") != "")
                         & (text("url") != ""))
    no_tags = F.array().cast("array<string>")
    given = F.when(~F.map_contains_key("e", "tags"), no_tags).otherwise(_tag_list(field("tags")))
    lo, hi = parse_k_range(field("salary"))
    return _finish(rows.select(
        *keep, F.col("pos").cast("bigint").alias("pos"),
        F.coalesce(field("id"), F.lit("")).alias("external_id"), F.lit(source).alias("source"),
        text("title").alias("title"), text("company_name").alias("company"),
        field("company_logo").alias("company_url"),
        F.when(~F.map_contains_key("e", "description"), "").otherwise(field("description"))
        .alias("description"),
        text("url").alias("url"),
        F.coalesce(blank_to_null(text("candidate_required_location")), F.lit("Remote"))
        .alias("location"),
        lo.alias("salary_min"), hi.alias("salary_max"),
        append_if_absent(given, field("category")).alias("tags"),
        field("job_type").alias("job_type"),
        iso_as_utc(field("publication_date")).alias("date_posted"), "raw_data"))
