"""Whole crawl records: late fetch of texts when merging, and order of the written log."""

import glob
import json
import random

from joblattice.operators.crawl_log import by_company, merge_recrawl
from joblattice.session import new_folder
from joblattice.sinks.files import write_crawl_log
from joblattice.sources.crawl_log import read_crawl_lines

SCHEMA = "seq long, company string, error string, text string, links array<struct<text:string,href:string>>"


def log(spark, rows):
    return spark.createDataFrame([(s, c, e, t, [("a", f"u{s}")]) for s, c, e, t in rows], SCHEMA)


def test_last_row_of_a_company_wins_with_its_text_and_links(spark):
    old = [(1, "A", None, "a1"), (2, "B", "x", None), (3, "A", None, "a3"), (4, None, "x", None),
           (9, "C", None, "c9")]
    new = [(1, "A", None, "fresh"), (2, "D", None, "d"), (5, None, None, "n"), (0, "A", "x", None)]
    got = merge_recrawl(log(spark, old), log(spark, new)).collect()
    assert sorted((r["company"] or "", r["seq"], r["text"], r["links"][0]["href"]) for r in got) == [
        ("", 5, "n", "u5"), ("A", 1, "fresh", "u1"), ("B", 2, None, "u2"), ("C", 9, "c9", "u9"),
        ("D", 2, "d", "u2")]


def test_an_empty_recrawl_keeps_the_log(spark):
    old = log(spark, [(1, "A", None, "a"), (2, "A", None, "b")])
    assert [r["seq"] for r in merge_recrawl(old, old.where("false")).collect()] == [2]


def test_texts_and_links_are_neither_sorted_nor_grouped(spark, monkeypatch):
    from joblattice.operators import crawl_log
    plans = []
    real = crawl_log.cut_lineage

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)
    monkeypatch.setattr(crawl_log, "cut_lineage", spy)
    path = new_folder(spark, "log")
    log(spark, [(i, f"c{i % 7}", None, "t" * 50) for i in range(50)]).write.parquet(path)
    stored = spark.read.parquet(path)
    merged = merge_recrawl(stored, stored)
    (decided,) = plans
    assert "text" not in decided and "links" not in decided
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_one_company_is_spread_over_the_files_of_a_log(spark):
    rows = [(i, "Acme", None, f"t{i}") for i in range(3_000)] + [(5_000, "acme", None, "x"),
                                                                 (5_001, "Aaa", None, "y")]
    random.Random(1).shuffle(rows)
    path = new_folder(spark, "log")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # small slices stay
    try:
        write_crawl_log(log(spark, rows).repartition(4), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(glob.glob(f"{path}/part-*"))
    texts = [[json.loads(line) for line in open(f, encoding="utf-8")] for f in files]
    order = [(r["company"], r["seq"]) for f in texts for r in f]
    assert order == [("Aaa", 5_001), *[("Acme", i) for i in range(3_000)], ("acme", 5_000)]
    assert sum(any(r["company"] == "Acme" for r in f) for f in texts) > 1
    assert read_crawl_lines(spark, path).count() == 3_002


def test_order_without_a_sequence(spark):
    df = log(spark, [(1, "b", None, ""), (2, "A", None, ""), (3, None, None, "")]).drop("seq")
    assert [r["company"] for r in by_company(df).collect()] == [None, "A", "b"]
