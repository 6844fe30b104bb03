"""Ingest, store, read back and match: ids of inserted rows and orders of any size."""

import pytest
from pyspark.sql import functions as F

from joblattice import schemas
from joblattice.functions.scoring import Profile
from joblattice.operators import matching as M
from joblattice.operators import ranking as R
from joblattice.operators.companies import upsert_companies
from joblattice.operators.merge import upsert_listings
from joblattice.plans import jobs as J
from joblattice.sinks.files import write_listings
from joblattice.session import new_folder

PROFILE = Profile(roles=("Data Engineer",), preferred_keywords=("spark",))


def _stored(spark, rows):
    names = schemas.LISTING.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.LISTING)


def _feed(spark, rows, extra=""):
    return spark.createDataFrame(rows, "seq long, external_id string, title string, company string, "
                                 "url string, description string, dedup_hash string" + extra) \
        .withColumn("source", F.lit("feed")) \
        .withColumn("date_scraped", F.lit("2024-01-01").cast("timestamp")) \
        .withColumn("tags", F.array(F.lit("spark")))


def test_inserted_rows_follow_the_largest_stored_id(spark):
    stored = _stored(spark, [{"id": 41, "title": "t", "company": "c", "dedup_hash": "h0",
                              "source": "feed", "external_id": "e0", "is_active": True}])
    batch = _feed(spark, [(9, "e2", "b", "c", "u2", "d", "h2"), (3, "e1", "a", "c", "u1", "d", "h1"),
                          (5, "e0x", "t", "c", "u0", "d", "h0"), (7, "e0", "x", "c", "u3", "d", "h3")])
    snapshot = upsert_listings(stored, batch).snapshot
    ids = {r["dedup_hash"]: r["id"] for r in snapshot.collect()}
    assert ids == {"h0": 41, "h1": 42, "h2": 43}            # h0 touched, h3's external id is taken


def test_ids_of_a_batch_are_kept(spark):
    batch = _feed(spark, [(1, "e", "a", "c", "u", "d", "h")]).withColumn("id", F.lit(7).cast("long"))
    assert [r["id"] for r in upsert_listings(_stored(spark, []), batch).snapshot.collect()] == [7]


def test_written_snapshot_can_be_matched(spark):
    batch = _feed(spark, [(2, "b", "Data Engineer", "B", "u2", "spark", "h2"),
                          (1, "a", "Data Engineer", "A", "u1", "spark", "h1")])
    done = J.ingest_feeds(_stored(spark, []), {"feed": lambda: batch})
    path = new_folder(spark, "listings")
    write_listings(done.result.snapshot, path)
    stored = spark.read.parquet(path)
    assert "seq" not in stored.columns
    for report in (J.unified_matching(stored, None, PROFILE), J.listing_matching(stored, PROFILE)):
        assert [(r["rank"], r["company"]) for r in report.orderBy("rank").collect()] == [(1, "A"), (2, "B")]


def test_feeds_ordered_by_page_and_position_are_numbered(spark):
    paged = _feed(spark, [(8, "a", "A", "c", "u1", "d", "h1", 1), (8, "b", "B", "c", "u2", "d", "h2", 0)],
                  ", pos int")
    plain = _feed(spark, [(8, "c", "C", "c", "u3", "d", "h3")])
    done = J.ingest_feeds(_stored(spark, []), {"paged": lambda: paged, "plain": lambda: plain})
    assert {r["dedup_hash"]: r["id"] for r in done.result.snapshot.collect()} == {"h2": 1, "h1": 2, "h3": 3}


@pytest.mark.parametrize("page", [1, 1 << 44, 1 << 60])
def test_large_page_numbers_keep_their_order(spark, page):
    links = [("Data Engineer one", "https://a/1"), ("Data Engineer two", "https://a/2")]
    pages = spark.createDataFrame(
        [(page, "Co", "https://a", "https://a", None, "text", links)],
        "seq long, company string, careers_url string, final_url string, error string, text string, "
        "links array<struct<text:string,href:string>>")
    rows = [(r["seq"], r["pos"], r["url"]) for r in M.career_page_rows(pages).orderBy("pos").collect()]
    assert rows == [(page, 0, "https://a/1"), (page, 1, "https://a/2")]
    report = J.unified_matching(_stored(spark, []), pages, PROFILE).orderBy("rank").collect()
    assert [r["apply_link"] for r in report] == ["https://a/1", "https://a/2"]


def test_numbering_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_ROWS", 50)
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("score"))      # three hot scores
    got = {r["id"]: r["rank"] for r in R.rank_all(df, "score", "id").collect()}
    order = sorted(range(1000), key=lambda i: (-(i % 3), i))
    assert got == {i: at + 1 for at, i in enumerate(order)}


def test_numbering_an_empty_table(spark):
    assert R.rank_all(spark.range(0).withColumn("s", F.lit(1)), "s", "id").count() == 0


def test_company_order_may_be_a_struct(spark):
    names = "name string, website string, careers_url string, description string, size string, " \
            "remote_policy string, tech_stack array<string>, source string"
    stored = spark.createDataFrame([("a", "old", None, None, "1", None, ["x"], "s")], names)
    batch = spark.createDataFrame([("a", "w1", None, None, None, None, ["y"], "s", 1, 1 << 62),
                                   ("a", "w0", None, None, None, None, ["z"], "s", 0, 5)],
                                  names + ", rank int, n long")
    row = upsert_companies(stored, batch.withColumn("seq", F.struct("rank", "n"))).first()
    assert (row["website"], row["size"], row["tech_stack"]) == ("w1", "1", ["y"])


def test_runs_are_those_of_feeds_and_all_may_fail(spark):
    stored = _stored(spark, [{"id": 41, "title": "t", "company": "c", "dedup_hash": "h0",
                              "source": "feed", "external_id": "e0", "is_active": True}])
    one = _feed(spark, [(1, "e1", "a", "c", "u1", "d", "h1"), (2, "e2", "t", "c", "u0", "d", "h0")])
    two = _feed(spark, [(3, "e3", "b", "c", "u2", "d", "h1")])
    late = two.withColumn("title", F.raise_error(F.lit("broke")).cast("string"))

    def gone():
        raise OSError("no route\nto host")
    feeds = {"one": lambda: one, "late": lambda: late, "two": lambda: two,
             "empty": lambda: two.limit(0), "gone": gone}
    done = J.ingest_feeds(stored, feeds, first_run=7)
    runs = {r["source"]: r for r in done.runs.collect()}       # all rows name the source "feed"
    assert {k: (r["id"], r["jobs_found"], r["jobs_new"], r["status"]) for k, r in runs.items()} == {
        "one": (7, 2, 1, "completed"), "late": (8, 0, 0, "failed"), "two": (9, 1, 0, "completed"),
        "empty": (10, 0, 0, "completed"), "gone": (11, 0, 0, "failed")}
    assert "broke" in runs["late"]["error_message"] and runs["gone"]["error_message"] == "no route"
    assert runs["one"]["error_message"] is None
    assert all(r["started_at"] <= r["finished_at"] for r in runs.values())
    assert {r["dedup_hash"] for r in done.result.snapshot.collect()} == {"h0", "h1"}
    none = J.ingest_feeds(stored, {"late": lambda: late, "gone": gone})
    assert [r["status"] for r in none.runs.collect()] == ["failed", "failed"]
    assert none.result.snapshot.collect() == stored.collect()
    assert none.result.counts().count() == 0


def test_a_slice_of_arrivals_is_written_by_many_tasks_and_companies_are_merged_in_many(spark):
    import glob

    from catalog.q_merge import _in_slices
    from joblattice.streaming import incremental as I
    cols = "name string, website string, careers_url string, description string, size string, " \
        "remote_policy string, tech_stack array<string>, source string"
    base = spark.createDataFrame([("a", "w", None, None, None, None, ["x"], "s")], cols)
    new = spark.createDataFrame(
        [(f"n{i % 7}", f"w{i}", None, "d" if i < 9 else None, None, None, [str(i)], "t", i)
         for i in range(60)], cols + ", seq long").repartition(4)
    root, files = new_folder(spark, "stream"), []
    for stream in _in_slices(spark, None, new, "seq"):
        I.ingest_companies(stream, root + "/store", root + "/log", base).awaitTermination()
        arrived = new_folder(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
        files.append(len(glob.glob(f"{arrived}/arrivals-*/part-*.parquet")))
    assert files[0] > 1
    got = I.current_companies(spark, root + "/store", base, task_rows=5)
    want = upsert_companies(base, new)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(
        map(str, want.select(columns).collect()))
