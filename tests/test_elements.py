"""Element scoping: fields end at their own tag and cards lie in their containers."""

import pytest
from pyspark.sql import functions as F

from joblattice.operators import elements as EL
from joblattice.sources import boards as B


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "/categories/remote-data-jobs", h)
                                  for i, h in enumerate(htmls)],
                                 "page_id long, cat_path string, html string")


def posting(href, title="T", company="C", place="Oslo", cls="unlocked"):
    return (f'<a class="listing-link--{cls}" href="{href}"><h3 class="new-listing__header__title__text">'
            f'{title}</h3><div><p class="new-listing__company-name">{company}</p></div>'
            f'<p class="new-listing__company-headquarters">{place}</p></a>')


def page(*items, before="", after=""):
    return (f'<html><body>{before}<section class="jobs list"><article><ul>'
            + "".join(f"<li>{i}</li>" for i in items) + f"</ul></article></section>{after}</body></html>")


def parsed(spark, *htmls):
    rows = B.parse_category_pages(pages(spark, *htmls)).orderBy("seq", "pos").collect()
    return [(r["title"], r["company"], r["url"].rsplit("/", 1)[1], r["location"]) for r in rows]


def test_fields_end_at_their_own_tag(spark):
    html = page(posting("/a", "Lead <b>Data</b> <i>Eng</i>", "<span>Acme</span> Inc<br>Ltd",
                        "<p>In</p>ner &amp; out"))
    assert parsed(spark, html) == [("LeadDataEng", "AcmeIncLtd", "a", "Inner & out")]


@pytest.mark.parametrize("outside", [
    f"<div>{posting('/ad')}</div>", f"<ul><li>{posting('/ad')}</li></ul>",
    f"<section class='jobs'>{posting('/ad')}</section>",
    f"<section class='nojobs'><article><ul><li>{posting('/ad')}</li></ul></article></section>",
    f"<!-- <section class='jobs'><article><ul><li>{posting('/ad')}</li></ul></article></section> -->",
    f"<section class='jobs'><article><ul></ul><li>{posting('/ad')}</li></article></section>"])
def test_postings_outside_the_list_are_none(spark, outside):
    assert [r[2] for r in parsed(spark, page(posting("/a"), before=outside))] == ["a"]
    assert [r[2] for r in parsed(spark, page(posting("/a"), after=outside))] == ["a"]


def test_first_link_of_an_item_counts(spark):
    nested = f"<ul><li>{posting('/inner')}</li></ul>"
    html = page(posting("/a") + posting("/b"), f"<span>{posting('/c')}</span>",
                posting("/d") + nested, nested.replace("inner", "deep") + posting("/e"))
    assert [r[2] for r in parsed(spark, html)] == ["a", "c", "d", "inner", "deep", "e"]


def test_missing_and_blank_fields(spark):
    html = page(posting("/a", title=" "), posting("/b", company=""), posting("javascript:x/1"),
                posting("/c", place=" "), '<a class="listing-link--locked" href="/d">bare</a>')
    assert parsed(spark, html, "", None, "<li>", "a < b > c") == [("T", "C", "c", "Remote")]


def test_unclosed_and_self_closed_elements(spark):
    html = ('<section class=jobs><article><ul><li>' + posting("/a", "x<br/>y<img src=u>z")
            + "<li>" + posting("/b") + "</ul></article></section>")
    assert [r[::2] for r in parsed(spark, html)] == [("xyz", "a"), ("T", "b")]


def test_attributes_and_classes(spark):
    df = spark.createDataFrame([(""" data-href="no" CLASS='a b-c' href=x&amp;y""",)], "a string")
    row = df.select(EL.attribute(F.col("a"), "href"), EL.attribute(F.col("a"), "class"),
                    EL.has_class(F.lit("a b-c"), "b"), EL.has_class(F.lit("a b-c"), "z", "b-c")).first()
    assert tuple(row) == ("x&y", "a b-c", False, True)


def test_texts_of_cards_are_lines(spark):
    html = '<a href="/job/1"><div> Data\n  Engineer </div>Acme <b>Inc</b><p></p></a><p>after</p>'
    assert [r["title"] for r in B.link_cards(pages(spark, html)).collect()] == [
        "Data Engineer\nAcme Inc"]


def test_cards_after_a_nested_division(spark):
    html = ('<article><div class="company">In <b>here</b></div><a href="/jobs/1">One</a></article>'
            '<a href="/jobs/2">No card</a>')
    rows = B.titled_cards(pages(spark, html)).collect()
    assert [(r["href"], r["title"], r["company"]) for r in rows] == [("/jobs/1", "One", "In here")]


def test_wrappers_and_parts_named_like_cards(spark):
    html = ('<div class="job-card-list">' + "".join(
        f'<div class="job-card"><h3 class="job-card__title">T{k}</h3><p class="x-company">C{k}</p></div>'
        for k in range(2)) + "</div>")
    rows = B.board_cards(pages(spark, html)).orderBy("seq").collect()
    assert [(r["title"], r["company"]) for r in rows] == [("T0", "C0"), ("T1", "C1")]


def test_empty_pages(spark):
    assert B.link_cards(pages(spark).where("false")).count() == 0
    assert B.board_cards(pages(spark, "", None)).count() == 0


def test_pages_are_dealt_out_by_the_size_of_their_markup_in_one_exchange(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "repeat('<p>x</p>', 100) AS html")
    few = EL.spread_pages(pages, "page_id", "html")
    many = EL.spread_pages(pages, "page_id", "html", task_chars=8_000)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert many.rdd.getNumPartitions() == 40 and many.count() == 400
