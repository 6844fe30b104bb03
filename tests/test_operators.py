"""Equivalence with straightforward row-by-row definitions, on small random inputs."""

import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from joblattice.functions.near_texts import near_texts
from joblattice.functions.similarity import sorted_tokens
from joblattice.functions.text import dedup_hash
from joblattice.operators import companies as C
from joblattice.operators import crawl_log as O
from joblattice.operators import dedup as DD
from joblattice.operators import merge as MG
from joblattice.operators import ranking as R

LISTING = "id bigint, source string, external_id string, dedup_hash string, date_scraped timestamp, is_active boolean"


def _moment(i):
    return datetime(2024, 1, 1 + i // 24, i % 24)


def _sequential(stored, batch):
    """Row-at-a-time upsert over dictionaries."""
    rows = [dict(r) for r in stored]
    labels = {}
    for r in batch:
        known = next((x for x in rows if r["dedup_hash"] and x["dedup_hash"] == r["dedup_hash"]), None)
        if known:
            known.update(date_scraped=r["date_scraped"], is_active=True)
            labels[r["seq"]] = "touch"
        elif r["external_id"] is not None and any(
                (x["source"], x["external_id"]) == (r["source"], r["external_id"]) for x in rows):
            labels[r["seq"]] = "ignored"
        else:
            rows.append({k: r[k] for k in ("id", "source", "external_id", "dedup_hash", "date_scraped")}
                        | {"is_active": True})
            labels[r["seq"]] = "insert"
    return rows, labels


@pytest.mark.parametrize("seed", range(6))
def test_upsert_equals_sequential_loop(spark, seed, monkeypatch):
    if seed % 2:                                  # joins instead of broadcasts
        monkeypatch.setattr(MG, "is_small", lambda df: False)
    rnd = random.Random(seed)

    def row(i, seq=None):
        r = {"id": i, "source": rnd.choice("ab"), "external_id": rnd.choice([None, "", "1", "2", "3", "4", "5"]),
             "dedup_hash": rnd.choice([None, "", *"hijklmnop"]), "date_scraped": _moment(i),
             "is_active": rnd.random() < 0.5}
        return r if seq is None else r | {"seq": seq}
    first, _ = _sequential([], [row(i, i) for i in range(6)])
    batch = [row(100 + s, s) for s in range(40)]
    want_rows, want_labels = _sequential(first, batch)
    stored = spark.createDataFrame(first, LISTING)
    incoming = spark.createDataFrame(batch, LISTING + ", seq bigint")
    result = MG.upsert_listings(stored, incoming)
    assert {r["seq"]: r["label"] for r in result.labels.collect()} == want_labels
    got = {r["id"]: (r["date_scraped"], r["is_active"]) for r in result.snapshot.collect()}
    assert got == {r["id"]: (r["date_scraped"], r["is_active"]) for r in want_rows}


def test_ignored_rows_count_as_new(spark):
    stored = spark.createDataFrame([(1, "a", "1", "h", _moment(0), False)], LISTING)
    batch = spark.createDataFrame([(2, "a", "1", "x", _moment(1), True, 0), (3, "a", "9", "h", _moment(2), True, 1)],
                                  LISTING + ", seq bigint")
    counts = MG.upsert_listings(stored, batch).counts().first()
    assert (counts["jobs_found"], counts["inserted"], counts["touched"], counts["ignored"], counts["jobs_new"]) == (2, 0, 1, 1, 1)


def test_company_upsert_keeps_and_clears(spark):
    schema = ("name string, website string, careers_url string, description string, size string, "
              "remote_policy string, tech_stack array<string>, source string")
    old = spark.createDataFrame([("A", "w", None, None, None, None, ["a"], "s")], schema)
    new = spark.createDataFrame([("A", None, "c", None, None, None, [], "t", 1), ("B", None, None, None, None, None, None, None, 2)],
                                schema + ", seq bigint")
    got = {r["name"]: r for r in C.upsert_companies(old, new).collect()}
    assert (got["A"]["website"], got["A"]["careers_url"], got["A"]["tech_stack"], got["A"]["source"]) == ("w", "c", [], "t")
    assert got["B"]["tech_stack"] == []
    kept = {r["name"]: r for r in C.upsert_companies(old, new, keep_nonempty=True).collect()}
    assert kept["A"]["tech_stack"] == ["a"]


def _score(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    from fractions import Fraction
    total = len(a) + len(b)
    return round(100 * (1 - Fraction(total - 2 * row[-1], total)))


@pytest.mark.parametrize("threshold,cell_rows", [(85, 3), (70, 20_000), (90, 1)])
def test_fuzzy_matches_equal_brute_force(spark, threshold, cell_rows):
    rnd = random.Random(threshold)
    words = ["data", "engineer", "senior", "sql", "ops", "analyst", "lead", "cloud", "backend", "go"]
    companies = ["Acme", "Acme Labs", "Unknown", "ab", "The Acme Group International Ltd"]

    def title():
        t = " ".join(rnd.sample(words, rnd.randint(1, 5)))
        i = rnd.randrange(len(t))
        return t[:i] + rnd.choice("xyz ") + t[i + rnd.randint(0, 1):]

    def rows(n, base):
        # A third of the rows share one company.
        return [(base + i, title(), "Unknown" if i % 3 == 0 else rnd.choice(companies), "s", f"u{i}", i % 7 != 0)
                for i in range(n)]
    schema = "id bigint, title string, company string, source string, url string, is_active boolean"

    def frame(data):
        df = spark.createDataFrame(data, schema)
        return df.withColumn("dedup_hash", dedup_hash(F.col("title"), F.col("company")))
    stored, batch = frame(rows(70, 1000)), frame(rows(50, 0))
    texts = {df: [(r["id"], r["t"], r["company"], r["is_active"]) for r in df.select(
        "id", sorted_tokens(F.col("title"), F.col("company")).alias("t"), "company", "is_active").collect()]
        for df in (stored, batch)}
    want, similar = set(), set()
    for i, a, company, _ in texts[batch]:
        key = company.strip()[:20].lower()
        for _, b, other, active in texts[stored]:
            if active and key in other.lower() and _score(a, b) >= threshold:
                want.add((a, key, b, other.lower(), _score(a, b)))
                similar.add(i)
    got = {tuple(r) for r in DD.fuzzy_matches(batch, stored, threshold, cell_rows)
           .select("a", "key", "b", "b_company", "similarity").collect()}
    assert got == want
    hashes = {r[0] for r in stored.select("dedup_hash").collect()}
    tagged = DD.tag_duplicates(batch, stored, threshold, cell_rows=cell_rows).collect()
    assert len(tagged) == 50
    for r in tagged:
        kind = "exact" if r["dedup_hash"] in hashes else "fuzzy" if r["id"] in similar else None
        assert r["dup_kind"] == kind
    one = batch.first()
    single = {r["id"]: r["similarity"] for r in DD.find_fuzzy_duplicates(stored, one["title"], one["company"], threshold).collect()}
    a = next(t for i, t, *_ in texts[batch] if i == one["id"])
    key = one["company"].strip()[:20].lower()
    assert single == {i: _score(a, b) for i, b, other, active in texts[stored]
                      if active and key in other.lower() and _score(a, b) >= threshold}


def test_blank_company_meets_all_stored(spark):
    schema = "id bigint, title string, company string, source string, url string, is_active boolean"

    def frame(rows):
        df = spark.createDataFrame([(i, t, c, "s", f"u{i}", True) for i, t, c in rows], schema)
        return df.withColumn("dedup_hash", dedup_hash(F.col("title"), F.col("company")))
    stored = frame([(1, "senior data engineer platform team", "Ab"), (2, "gardener", "Acme"),
                    (3, "senior data engineer platform team x", "")])
    batch = frame([(7, "senior data engineer platform team", " "), (8, "pilot", "")])
    got = {r["b_company"] for r in DD.fuzzy_matches(batch, stored).collect()}
    want = {r["company"].lower() for r in DD.find_fuzzy_duplicates(
        stored, "senior data engineer platform team", " ").collect()}
    assert got == want == {"ab", ""}
    tags = {r["id"]: r["dup_kind"] for r in DD.tag_duplicates(batch, stored).collect()}
    assert tags == {7: "fuzzy", 8: None}


def test_contained_in(spark):
    rnd = random.Random(3)
    keys = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(60)}
    names = {"".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 12))) for _ in range(60)}
    got = {tuple(r) for r in DD.contained_in(
        spark.createDataFrame([(k,) for k in keys], "key string"),
        spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(k, n) for k in keys for n in names if k in n}


def test_rank_all_equals_window(spark):
    df = spark.range(500).select("id", (F.xxhash64("id") % 4).alias("score"))
    ranked = {r["id"]: r["rank"] for r in R.rank_all(df, "score", "id").collect()}
    window = Window.orderBy(F.col("score").desc(), "id")
    assert ranked == {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(window)).collect()}


def test_previous_value_equals_lag(spark):
    df = spark.range(300).select((F.xxhash64("id") % 3).alias("k"), F.col("id").alias("seq"),
                                 F.when(F.col("id") % 5 != 0, F.col("id") * 2).alias("v"))
    got = {r["seq"]: r["p"] for r in R.previous_value(df, "k", "seq", "v", "p", slice_rows=20).collect()}
    window = Window.partitionBy("k").orderBy("seq")
    assert got == {r["seq"]: r["p"] for r in df.withColumn("p", F.lag("v").over(window)).collect()}


def test_recovered_sees_the_merged_state(spark):
    schema = "company string, careers_url string, error string, text string, seq bigint"
    log = spark.createDataFrame([("a", "u", "e", None, 0), ("b", "u", None, "t", 1), ("a", "u", None, "t", 2)], schema)
    new = spark.createDataFrame([("a", "u", "e", None, 0), ("a", "u", None, "t", 1), ("c", "u", None, "t", 2),
                                 ("b", "u", None, "t", 3)], schema)
    # "a" was fine at last, fails, recovers; "c" is unknown; "b" stays fine.
    assert O.recovered_count(log, new).first()[0] == 2
    merged = {r["company"]: r["error"] for r in O.merge_recrawl(log, new).collect()}
    assert merged == {"a": None, "b": None, "c": None}


def test_success_by_cycle_gains(spark):
    rows = [(c, i, None if i < n else "e", "t") for c, n in enumerate([660, 736, 742, 756, 762, 764]) for i in range(852)]
    df = spark.createDataFrame(rows, "cycle bigint, i bigint, error string, text string")
    got = O.success_by_cycle(df).orderBy("cycle").collect()
    assert [r["gain"] for r in got] == [None, 76, 6, 14, 6, 2]
    assert got[-1]["success_pct"] == 89.7


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "company string, careers_url string, error string, text string")
    assert O.success_summary(empty).first().asDict() == {"total": 0, "success": 0, "failure": 0, "success_pct": 0.0}


def test_blank_domain_takes_a_place(spark):
    rows = [("", "e"), ("", "e"), ("http://a/x", "e"), ("http://b", "e")]
    df = spark.createDataFrame([(u, u, e, None) for u, e in rows], "company string, careers_url string, error string, text string")
    assert [r["domain"] for r in O.failures_by_domain(df, k=2).collect()] == ["a"]


def test_progress_metrics(spark):
    from pyspark.sql import Observation
    df = spark.createDataFrame([("a", "e"), ("b", None)], "company string, error string")
    seen = Observation("progress")
    O.progress_metrics(df, seen).collect()
    assert seen.get == {"completed": 2, "errors": 1}


def test_a_signature_of_tiers_tells_long_texts_apart_and_never_exceeds_the_indel(spark):
    from joblattice.functions import similarity as SI
    rows = [("the engineer " * 6, "those nineteen " * 5), ("e" * 30, "e" * 12), ("", "a" * 40),
            ("data lead 1" * 9, "lead data 22" * 9)]
    df = spark.createDataFrame(rows, "a string, b string")

    def bits(tiers):
        return SI.signature_distance(SI.signature(F.col("a"), tiers), SI.signature(F.col("b"), tiers))
    indel = F.length("a") + F.length("b") - 2 * SI.lcs_length_udf()(F.col("a"), F.col("b"))
    got = df.select(bits(1).alias("one"), bits(4).alias("four"), indel.alias("indel")).collect()
    assert all(r["one"] <= r["four"] <= r["indel"] for r in got)
    assert [r["four"] for r in got[1:3]] == [18, 32] and got[1]["one"] == 0


@pytest.mark.parametrize("threshold", [85, 90, 60])
def test_near_texts_of_two_groups_equal_brute_force(threshold):
    rnd = random.Random(threshold)

    def text(n):
        return "".join(rnd.choice("abcd eß1ż") for _ in range(n))

    def changed(t, n):
        chars = list(t)
        for _ in range(n):
            chars[rnd.randrange(len(chars)):][:1] = [rnd.choice("abcd e")]
            del chars[rnd.randrange(len(chars))]
            chars.insert(rnd.randrange(len(chars) + 1), rnd.choice("abz \U0001f600"))
        return "".join(chars)
    old = sorted({text(n) for n in [*range(1, 40), *range(60, 70), 127, 128, 129, 300, 700] for _ in range(3)})
    new = sorted({changed(t, int(len(t) * share) or 1) for t in old for share in (0.02, 0.1, 0.18)}
                 | {old[3], old[-1], "", "q"})
    old.append("")
    groups = (pa.table({"a": new, "key": ["k"] * len(new), "name": ["c"] * len(new)}),
              pa.table({"b": old}))
    want = {(a, b, indel) for a in new for b in old
            if (indel := len(a) + len(b) - 2 * _lcs(a, b)) <= _largest(len(a) + len(b), threshold)}
    pairs = near_texts(threshold, True)(*groups).to_pylist()
    assert len(pairs) == len(want) > 100
    assert {(r["a"], r["b"], r["indel"]) for r in pairs} == want
    keys = near_texts(threshold, False)(*groups).to_pylist()
    assert sorted(r["a"] for r in keys) == sorted({a for a, _, _ in want})
    assert near_texts(threshold, True)(groups[0].slice(0, 0), groups[1]).num_rows == 0


def test_listings_without_title_or_company_are_similar_to_none(spark):
    rows = [(1, None, "acme"), (2, "data engineer", None), (3, "data engineer", "acme"), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, company string").withColumns(
        {"dedup_hash": F.concat(F.lit("n"), F.col("id")), "is_active": F.lit(True)})
    stored = df.withColumn("dedup_hash", F.concat(F.lit("s"), F.col("id")))
    assert [r["similarity"] for r in DD.fuzzy_matches(df, stored).collect()] == [100]
    kinds = {r["id"]: r["dup_kind"] for r in DD.tag_duplicates(df, stored).collect()}
    assert kinds == {1: None, 2: None, 3: "fuzzy", 4: None}


def _lcs(a, b):
    masks = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(b)}
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & masks[c]
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _largest(total, threshold):
    doubled = total * (2 * (100 - threshold) + 1)
    return doubled // 200 if threshold % 2 == 0 else -(-doubled // 200) - 1
