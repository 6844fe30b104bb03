"""Properties of the physical plans that matter at scale."""

import os
import re

import pytest

from catalog import views as V
from joblattice.operators import dedup as DD
from joblattice.operators import listings as L
from joblattice.operators import matching as M
from joblattice.operators import ranking as R
from joblattice.operators.companies import upsert_companies
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_read_only_their_columns(spark):
    text = plan(L.count_by(V.listings(spark, SF), "source"))
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in text
    assert "GreaterThanOrEqual(n_chars,600)" in text


def test_search_is_a_top_k(spark):
    text = plan(L.search(V.listings(spark, SF), "x"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_scores_are_computed_once_and_before_the_shuffle(spark):
    df = M.match_all(V.listings(spark, SF), None, V.PROFILE)
    text = optimized(df)
    assert text.count("Contains(_text#") == len(set(re.findall(r"Contains\(_text#\d+, ([^)]*)\)", text)))
    physical = plan(df)
    below = physical[physical.index("Exchange hashpartitioning(url"):]
    assert "Generate explode" in below            # scoring sits below the url shuffle
    assert "description" not in physical.split("Exchange hashpartitioning(url")[0]


def test_first_per_key_cuts_before_the_shuffle(spark):
    text = plan(R.keep_first(V.listings(spark, SF).select("id", "url"), ["url"], F.col("id")))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_latest_values_aggregate_before_the_shuffle(spark):
    text = plan(upsert_companies(V.companies(spark, SF), V.company_batch(spark, SF)))
    assert "partial_max_by" in text and "Window" not in text and "Join" not in text


@pytest.mark.parametrize("build", [
    lambda s: M.match_all(V.listings(s, SF), V.crawl_log(s, SF), V.PROFILE),
    lambda s: DD.fuzzy_matches(V.listings(s, SF), V.known_listings(s, SF)),
    lambda s: DD.tag_duplicates(V.listings(s, SF), V.known_listings(s, SF)),
    lambda s: R.rank_all(M.match_listings(V.listings(s, SF), V.PROFILE).select("seq", "total"), "total", "seq")])
def test_no_nested_loops(spark, build):
    text = plan(build(spark))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_ranks_use_no_single_task_window_over_rows(spark):
    matches = M.match_listings(V.listings(spark, SF), V.PROFILE).select("seq", "total")
    text = optimized(R.rank_all(matches, "total", "seq"))
    assert "row_number" not in text
    # The single window adds up the sizes of the slices, never the rows.
    assert len(re.findall(r"Window \[", text)) == 1 and "_n#" in text


def scans_while(spark, monkeypatch, module, build, path):
    """Scans of ``path`` in all plans of a job, written tables included."""
    plans = []
    real = module.cut_lineage

    def spy(df):
        plans.append(plan(df))
        return real(df)
    monkeypatch.setattr(module, "cut_lineage", spy)
    plans.append(plan(build()))
    return sum(p.count(f"{path}.parquet") for p in plans)


def test_statistics_scan_each_table_once(spark, monkeypatch):
    rows, runs = V.listings(spark, SF), V.runs(spark, SF)
    assert scans_while(spark, monkeypatch, L, lambda: L.stats(rows, runs), "documents") == 1
    assert scans_while(spark, monkeypatch, L, lambda: L.stats(rows, runs), "events") == 1


def test_failure_report_scans_the_log_once_and_keeps_no_text(spark, monkeypatch):
    from joblattice.sinks import reports as RP
    log = V.error_log(spark, SF)
    assert scans_while(spark, monkeypatch, RP, lambda: RP.failure_report(log, "seq"), "pages") == 1


def test_statistics_of_an_empty_table(spark):
    rows = L.stats(V.listings(spark, SF).limit(0), V.runs(spark, SF).limit(0)).collect()
    assert [tuple(r) for r in rows] == [("total_active", "all", 0)]
