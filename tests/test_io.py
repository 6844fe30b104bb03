"""Readers and writers on files, and the streaming ingest."""

import glob
import json
import os
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.operators.companies import upsert_companies
from joblattice.operators.merge import upsert_listings
from joblattice.schemas import COMPANY, LISTING
from joblattice.sinks import files as K
from joblattice.sources import crawl_log as CL
from joblattice.sources import directories as DI
from joblattice.sources import feeds as FE
from joblattice.sources.profile import load_profile, profile_terms, read_profiles
from joblattice.streaming import incremental as I


def _listing(i, **over):
    row = {f.name: None for f in LISTING}
    row.update(id=i, external_id=str(i), source="s", title=f"Title {i}", company="Acme", url=f"http://u/{i}",
               tags=["a", "b"], date_scraped=datetime(2024, 1, 1 + i), is_active=True, dedup_hash=f"h{i}",
               salary_min=0, salary_max=1500)
    row.update(over)
    return tuple(row[f.name] for f in LISTING)


def _lines(path):
    return [line for p in sorted(glob.glob(f"{path}/part-*")) for line in open(p, encoding="utf-8").read().splitlines()]


def test_export_markdown(spark, tmp_path):
    df = spark.createDataFrame([_listing(1), _listing(2, location=""), _listing(3, is_active=False)], LISTING)
    out = str(tmp_path / "md")
    assert K.export_markdown(df, out) == 2
    assert _lines(out) == [
        "# Job Listings (2 results)", "", *K.MARKDOWN_HEAD,
        "| [Title 2](http://u/2) | Acme | — | ?–$1,500 | s |", "| [Title 1](http://u/1) | Acme | — | ?–$1,500 | s |"]
    assert K.export_markdown(df, out + "2", query="nothing") == 0 and not os.path.exists(out + "2")


def test_export_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([_listing(1, title='say "hi",\nyou'), _listing(2)], LISTING)
    assert K.export_csv(df, str(tmp_path / "csv"), limit=1) == 1
    assert K.export_csv(df, str(tmp_path / "all")) == 2
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "all"))
    assert {r["title"] for r in back.collect()} == {'say "hi",\nyou', "Title 2"}
    assert back.first()["tags"] == '["a", "b"]'
    assert K.export_json(df, str(tmp_path / "json"), query="TITLE") == 1
    assert json.loads(_lines(tmp_path / "json")[0])["title"] == "Title 2"


def test_crawl_log_files(spark, tmp_path):
    records = [{"company": c, "careers_url": "http://x", "error": e, "text": t, "links": [{"text": "a", "href": "b"}]}
               for c, e, t in (("b", None, "hi"), ("A", "boom", None), ("c", "", ""))]
    array, lines, bad = tmp_path / "log.json", tmp_path / "log.jsonl", tmp_path / "bad.json"
    array.write_text(json.dumps(records, indent=2))
    lines.write_text("\n".join(json.dumps(r) for r in records))
    bad.write_text(json.dumps(records)[:-20])
    assert CL.read_crawl_log(spark, str(array)).count() == 3
    assert [r["company"] for r in CL.read_successes(spark, str(array), str(lines)).collect()] == ["b"]
    assert [r["company"] for r in CL.read_successes(spark, str(tmp_path / "none.json"), str(lines)).collect()] == ["b"]
    assert CL.read_tolerant(spark, str(array)).count() == 3
    assert CL.read_tolerant(spark, str(bad)).count() == 0
    single = tmp_path / "single.json"
    single.write_text(json.dumps({"company": "alone"}))
    assert CL.read_tolerant(spark, str(single)).count() == 0
    assert CL.read_tolerant(spark, str(tmp_path / "none.json")).count() == 0
    K.write_crawl_log(CL.read_crawl_log(spark, str(array)), str(tmp_path / "sorted"))
    assert [json.loads(x)["company"] for x in _lines(tmp_path / "sorted")] == ["A", "b", "c"]


def test_markdown_directories(spark, tmp_path):
    (tmp_path / "b-corp.md").write_text("---\nwebsite: b.io\ntech:\n  - go\n---\n")
    (tmp_path / "a.md").write_text("---\ntitle: \"Alpha\"\ntitle: 'Omega'\nwebsite: http://w\ncareers_url: http://c\n---\ntext")
    (tmp_path / "c.md").write_text("no block")
    files = DI.read_markdown(spark, str(tmp_path / "*.md"))
    got = [(r["company"], r["careers_url"]) for r in DI.crawl_targets(files).orderBy("file_name").collect()]
    assert got == [("Omega", "http://c"), ("B Corp", "https://b.io")]
    assert [r["name"] for r in DI.parse_profile_files(files).collect()] == ["Omega"]


def test_feed_null_versus_absent(spark):
    entries = [{"position": "A", "company": "C"}, {"position": "B", "company": "C", "location": None},
               {"position": None, "company": "C"}, {"company": "C"}, {"position": " D ", "company": "C", "tags": "x, y"}]
    payloads = [json.dumps([{"legal": 1}, *entries]), json.dumps([{"legal": 1}]), json.dumps({"a": 1}), "no json"]
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    got = FE.parse_array_feed(df).collect()
    assert [(r["title"], r["tags"], r["location"]) for r in got] == [("A", [], "Remote"), ("D", ["x", "y"], "Remote")]
    jobs = [{"title": "T", "company_name": "C", "url": "u", "tags": ["a"], "category": "a", "salary": "$1k-$2k"},
            {"title": "T", "company_name": "C", "url": None}]
    rows = FE.parse_object_feed(spark.createDataFrame([(json.dumps({"jobs": jobs}),)], "payload string")).collect()
    assert [(r["tags"], r["salary_min"], r["salary_max"]) for r in rows] == [(["a"], 1000, 2000)]


def test_profile(spark, tmp_path):
    doc = {"preferences": {"roles": ["Cloud Cook"], "exclude_companies": ["Bad Co"], "preferred_keywords": ["kw"]},
           "cv": {"skills": {"technical": ["sql", "go"]}}}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(doc))
    terms = {(r["category"], r["term"], r["pos"], r["weight"]) for r in profile_terms(read_profiles(spark, str(path))).collect()}
    assert terms == {("role", "Cloud Cook", 0, 5), ("exclude_company", "Bad Co", 0, 0), ("keyword", "kw", 0, 2),
                     ("tech", "sql", 0, 2), ("tech", "go", 1, 2)}
    profile = load_profile(spark, str(path))
    assert (profile.roles, profile.technical, profile.methodology) == (("Cloud Cook",), ("sql", "go"), ())


def test_stream_equals_batch_by_batch(spark, tmp_path):
    batches = [[_listing(1), _listing(2)], [_listing(1, date_scraped=datetime(2024, 2, 1)), _listing(3, external_id="2")],
               [_listing(4), _listing(4, date_scraped=datetime(2024, 3, 1))]]
    schema = T.StructType([*LISTING.fields, T.StructField("seq", T.LongType())])
    source = tmp_path / "in"
    frames = []
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(*r, n * 10 + i) for i, r in enumerate(rows)], schema)
        df.coalesce(1).write.mode("append").parquet(str(source))
        frames.append(df)
    empty = spark.createDataFrame([], schema).drop("seq")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = I.ingest_listings(stream, str(tmp_path / "snap"), str(tmp_path / "log"), empty)
    query.awaitTermination()
    want = empty
    for df in frames:
        want = upsert_listings(want, df).snapshot
    cols = ["id", "dedup_hash", "date_scraped", "is_active"]
    got = I.current_listings(spark, str(tmp_path / "snap"), empty)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.count() == 3
    # Another checkpoint on the same root adds to what is there.
    more = tmp_path / "more"
    spark.createDataFrame([(*_listing(9), 100)], schema).coalesce(1).write.parquet(str(more))
    again = spark.readStream.schema(schema).parquet(str(more))
    I.ingest_listings(again, str(tmp_path / "snap"), str(tmp_path / "log2"), empty).awaitTermination()
    assert I.current_listings(spark, str(tmp_path / "snap"), empty).count() == 4


def test_company_stream(spark, tmp_path):
    schema = "seq bigint, name string, website string, careers_url string, description string, size string, " \
             "remote_policy string, tech_stack array<string>, source string"
    rows = [(1, "A", "w1", None, None, None, None, ["x"], "s"), (2, "A", None, "c2", None, None, None, [], "s")]
    source = tmp_path / "in"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(source))
    empty = spark.createDataFrame([], COMPANY)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = I.ingest_companies(stream, str(tmp_path / "snap"), str(tmp_path / "log"), empty)
    query.awaitTermination()
    got = I.current_companies(spark, str(tmp_path / "snap"), empty).first()
    want = upsert_companies(empty, spark.createDataFrame(rows, schema)).first()
    assert (got["website"], got["careers_url"], got["tech_stack"]) == (want["website"], want["careers_url"], want["tech_stack"])


def test_listings_snapshot_is_partitioned(spark, tmp_path):
    df = spark.createDataFrame([_listing(1), _listing(2, source="t")], LISTING)
    K.write_listings(df, str(tmp_path / "snap"))
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "snap" / "source=*"))) == ["source=s", "source=t"]
    assert spark.read.parquet(str(tmp_path / "snap")).where(F.col("source") == "t").count() == 1
