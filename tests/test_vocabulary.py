"""Matching against many profiles: same hits as the literal form, plan free of the profiles."""

import random

import pytest
from pyspark.sql import functions as F

from joblattice.functions import scoring as SC
from joblattice.operators import vocabulary as VO

SCHEMA = "profile_id string, category string, term string, pos long, weight long, mode string"


def term_rows(profiles):
    return [(p.profile_id, name, term, pos, SC.WEIGHTS[name], mode)
            for p in profiles for name, terms, mode in SC.CATEGORIES
            for pos, term in enumerate(getattr(p, terms))]


def profile(k, rng, words):
    def pick(n):
        return " ".join(rng.choices(words, k=n))
    return SC.Profile(
        roles=(pick(2), pick(1)), preferred_keywords=(pick(1)[:2], pick(1)[:1], pick(2)[1:-1]),
        operations_finance=(pick(2), pick(3)), technical=(pick(1), pick(2), pick(1)),
        methodology=(pick(1)[1:], pick(4)[2:-2]), exclude_keywords=(pick(3)[1:],),
        profile_id=f"p{k}")


@pytest.fixture(scope="module")
def words():
    return ["data", "lead", "c++", "a/b", "sql", "été", "r", "go", "ops-lead", "datum", "node.js",
            "x_y", "Remote", "büro", "c", "q&a", "(us)", "senior"]


def texts(rng, words, n):
    out = []
    for i in range(n):
        line = ""
        for _ in range(rng.randint(0, 14)):
            line += rng.choice(words).lower() + rng.choice([" ", " ", " ", "  ", "\n", ", ", ". "])
        out.append((i, rng.choice(["", " "]) + line))
    return [*out, (n, None), (n + 1, ""), (n + 2, "   "), (n + 3, "c++"), (n + 4, "é" * 40_000)]


def test_same_hits_as_the_literal_form(spark, words):
    rng = random.Random(5)
    profiles = [profile(k, rng, words) for k in range(25)]
    rows = spark.createDataFrame(texts(rng, words, 150), "seq long, x string")
    title = F.substring(F.coalesce("x", F.lit("")), 1, 20)
    body = F.coalesce("x", F.lit(""))
    terms = spark.createDataFrame(term_rows(profiles), SCHEMA)
    got = VO.vocabulary_matches(rows, "seq", title, body, terms)
    columns = ["seq", "profile_id", "category", "term", "pos", "weight"]
    got = sorted(tuple(r) for r in got.select(columns).collect())
    want = [r for p in profiles for r in SC.vocabulary_hits(
        rows.select("seq", title.alias("t"), body.alias("b")), "seq", F.col("t"), F.col("b"), [p])
        .select(columns).collect()]
    plain = {t for t in (r[2] for r in term_rows(profiles)) if t and t.strip() == t}
    want = sorted(tuple(r) for r in want if r["term"] in plain)
    assert [r for r in got if r[3] in plain] == want
    assert len(want) > 2_000


def test_no_terms_and_no_texts(spark):
    rows = spark.createDataFrame([(1, "a b")], "seq long, x string")
    none = spark.createDataFrame([], SCHEMA)
    assert VO.vocabulary_matches(rows, "seq", F.col("x"), F.col("x"), none).count() == 0
    some = spark.createDataFrame([("p", "ops", "a b", 0, 3, "substring"),
                                  ("p", "tech", " ", 0, 2, "whole_word")], SCHEMA)
    assert VO.vocabulary_matches(rows.where("false"), "seq", F.col("x"), F.col("x"),
                                 some).count() == 0
    assert VO.vocabulary_matches(rows, "seq", F.col("x"), F.col("x"), some).count() == 1


def test_plan_does_not_grow_with_the_profiles(spark, words):
    rows = spark.createDataFrame([(1, "data lead")], "seq long, x string")
    sizes = []
    for n in (3, 300):
        rng = random.Random(1)
        terms = spark.createDataFrame(term_rows([profile(k, rng, words) for k in range(n)]),
                                      SCHEMA).repartition(2)
        hits = VO.vocabulary_matches(rows, "seq", F.col("x"), F.col("x"), terms)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("\n"))
    assert sizes[0] == sizes[1]


def test_excluded_companies_leave_only_their_profile(spark):
    terms = spark.createDataFrame(
        [("a", "keyword", "data", 0, 2, "substring"), ("b", "keyword", "data", 0, 2, "substring"),
         ("b", "exclude_company", "ACME", 0, 0, "company")], SCHEMA)
    listings = spark.createDataFrame(
        [(1, "Data", " acme ", "u", "s", None, None, None, "x", ["t"], True),
         (2, "Data", "Other", "u", "s", None, None, None, None, None, True),
         (3, "Data", "Other", "u", "s", None, None, None, None, None, False),
         (4, None, "Other", "u", "s", None, None, None, None, None, True)],
        "id long, title string, company string, url string, source string, location string, "
        "salary_min long, salary_max long, description string, tags array<string>, "
        "is_active boolean")
    got = VO.match_profiles(listings, terms).select("seq", "profile_id", "total").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 2), (2, "a", 2), (2, "b", 2)]


def test_common_needles_are_looked_for_in_the_texts_with_the_same_hits(spark, words):
    rng = random.Random(8)
    rows = spark.createDataFrame(texts(rng, words, 40), "seq long, x string")
    terms = spark.createDataFrame(
        [("p", "keyword", t, i, 2, "substring") for i, t in enumerate(["a", "s", "sql", "d", "a"])]
        + [("p", "role", "lead data", 0, 5, "any_word_gt3"), ("p", "tech", "r", 0, 2, "whole_word")],
        SCHEMA)
    by_tokens, by_texts = (sorted(map(tuple, VO.vocabulary_matches(
        rows, "seq", F.col("x"), F.col("x"), terms, common=n).collect())) for n in (0, 128))
    assert by_tokens == by_texts and len(set(by_texts)) == len(by_texts) > 40
