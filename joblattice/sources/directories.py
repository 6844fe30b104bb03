"""Markdown directories -> companies and crawl targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, let, lines, name_from_stem, split_list, strip
from ..functions.urls import pick_site_url
from ..operators.compute import compute_once
from .boards import union_all

# Directory names in load order, stop names, and the two entry patterns.
SOURCES = ("remoteintech", "yanirs", "fireball")
LISTED_POLICY = "fully-remote"
STOP_NAMES = ("awesome", "values", "culture", "glassdoor")
TABLE_ENTRY = r"\[([^\]]+)\]\((https?://[^\)]+)\)\s*\|\s*([^|]+)\|\s*([^|]+)"
LIST_ENTRY = r"\[([^\]]+)\]\((https?://[^\)]+)\)\s*[-–—]\s*([^<\n]+)"
FRONTMATTER = r"(?s)^---\s*\n(.*?)\n---"
KEY_LINE = r"^(\w+):\s*[\"']?(.*?)[\"']?\s*$"
ITEM_LINE = r"(?m)^\s+-\s+(.+)$"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files, one row per file: ``file_name``, ``text``."""
    return (spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
            .select("text", F.col("_metadata.file_name").alias("file_name")))


def frontmatter_block(text: Column) -> Column:
    """Text between the ``---`` lines, NULL when there is none."""
    return F.when(text.rlike(FRONTMATTER), F.regexp_extract(text, FRONTMATTER, 1))


def frontmatter(block: Column) -> Column:
    """``map<key, value>`` of the ``key: value`` lines; the last duplicate wins."""
    pairs = F.transform(F.filter(lines(block), lambda s: s.rlike(KEY_LINE)), lambda s: F.struct(
        F.regexp_extract(s, KEY_LINE, 1).alias("k"),
        strip(F.regexp_extract(s, KEY_LINE, 2)).alias("v")))
    last = let(pairs, lambda v: let(F.transform(v, lambda p: p["k"]), lambda keys: F.filter(
        v, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))))
    return F.map_from_entries(last)


def _value(fields: Column, key: str) -> Column:
    return F.try_element_at(fields, F.lit(key))


def crawl_targets(files: DataFrame) -> DataFrame:
    """(company, careers_url) per file; the name falls back to the file stem.

    The caller sorts by ``file_name`` where order matters.
    """
    fields = compute_once(files, {"f": frontmatter(frontmatter_block(F.col("text")))})
    stem = F.regexp_replace("file_name", r"\.md$", "")
    url = pick_site_url(_value(F.col("f"), "careers_url"), _value(F.col("f"), "website"))
    return fields.select(
        "file_name",
        F.coalesce(blank_to_null(_value(F.col("f"), "title")), name_from_stem(stem))
        .alias("company"),
        url.alias("careers_url")).where(F.col("careers_url").isNotNull())


def _company(df: DataFrame, keep, source: str, **cols: Column) -> DataFrame:
    fields = ("name", "website", "careers_url", "remote_policy", "size", "description")
    filled = {f: cols.get(f, F.lit(None)).cast("string") for f in fields}
    tech = cols.get("tech_stack", F.array()).cast("array<string>")
    return df.select(*keep, *[c.alias(n) for n, c in filled.items()], tech.alias("tech_stack"),
                     F.lit(source).alias("source"))


def parse_profile_files(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Company records of frontmatter files; every ``- item`` line is a tech entry."""
    block = frontmatter_block(F.col("text"))
    parsed = compute_once(files, {"_block": block}).where(F.col("_block").isNotNull())
    parsed = compute_once(parsed, {"_f": frontmatter(F.col("_block"))})
    f = F.col("_f")
    rows = parsed.where(F.coalesce(_value(f, "title"), F.lit("")) != "")
    return _company(rows, keep, SOURCES[0], name=_value(f, "title"), website=_value(f, "website"),
                    careers_url=_value(f, "careers_url"),
                    remote_policy=_value(f, "remote_policy"), size=_value(f, "company_size"),
                    tech_stack=F.regexp_extract_all("_block", F.lit(ITEM_LINE), F.lit(1)))


def _entries(df: DataFrame, keep, pattern: str, groups: int) -> DataFrame:
    found = [F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)), strip)
             .alias(f"g{g}") for g in range(1, groups + 1)]
    zipped = F.arrays_zip(*[F.col(f"g{g}") for g in range(1, groups + 1)])
    return (df.select(*keep, *found).select(*keep, F.posexplode(zipped).alias("pos", "m"))
            .select(*keep, F.col("pos").cast("bigint").alias("pos"), "m.*"))


def parse_table(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``[name](url) | business | tech, tech`` entries."""
    rows = _entries(files, keep, TABLE_ENTRY, 4)
    return _company(rows, [*keep, "pos"], SOURCES[1], name=F.col("g1"), website=F.col("g2"),
                    description=F.col("g3"), tech_stack=split_list(F.col("g4")),
                    remote_policy=F.lit(LISTED_POLICY))


def parse_list(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``[name](url) - text`` entries without headings and badges."""
    rows = _entries(files, keep, LIST_ENTRY, 3).where(~F.lower("g1").isin(*STOP_NAMES))
    return _company(rows, [*keep, "pos"], SOURCES[2], name=F.col("g1"), careers_url=F.col("g2"),
                    description=F.rtrim(F.col("g3"), F.lit(".")),
                    remote_policy=F.lit(LISTED_POLICY))


def union_directories(profile_files: DataFrame, table: DataFrame, listed: DataFrame) -> DataFrame:
    """All three directories in load order (``source_rank``)."""
    return union_all([profile_files, table, listed], rank="source_rank")
