"""HTML boards and link cards -> listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_int_range
from ..functions.text import (blank_to_null, category_name, dedup_hash, labelled_field,
                              location_from_tags, split_spans, split_title_company, strip,
                              stripped_lines)
from ..functions.urls import absolutize, resolve
from ..operators import elements as EL
from ..operators.compute import compute_once
from ..operators.ranking import keep_first

# Source names and site addresses.
CATEGORY_BOARD = ("weworkremotely", "https://weworkremotely.com")
TEXT_CARDS = ("dayonejobs", "https://www.dayonejobs.com")
TITLED_CARDS = ("startupjobs", "https://startup.jobs")
BOARD_CARDS = ("wellfound", "https://wellfound.com")
LINK_CARDS = ("remotefirstjobs", "https://remotefirstjobs.com")
LINE_CARDS = ("trueup", "https://www.trueup.io")
# Classes of one posting and its list on the category pages.
LIST_CLASS = "jobs"
POSTING_CLASSES = ("listing-link--unlocked", "listing-link--locked")
TITLE_CLASS = "new-listing__header__title__text"
COMPANY_CLASS = "new-listing__company-name"
PLACE_CLASS = "new-listing__company-headquarters"
SPAN_CLASS = "new-listing__categories__category"
# Classes of the cards of the other boards and of their fields.
TITLED_CARD = ("job-card", "job-listing")
TITLED_TITLE, TITLED_COMPANY = ("title", "job-title"), ("company", "company-name", "employer")
TITLED_PLACE = ("location", "job-location")
# Navigation texts that look like titles.
NAV_TITLES = ("view job post", "jobs")

_UNKNOWN, _REMOTE = "Unknown", "Remote"


def _listing(df: DataFrame, keep, source: str, **cols: Column) -> DataFrame:
    missing = {
        "external_id": "string", "company_url": "string", "description": "string",
        "location": "string", "salary_min": "bigint", "salary_max": "bigint",
        "tags": "array<string>", "job_type": "string", "experience_level": "string",
        "date_posted": "string", "raw_data": "string",
    }
    filled = {c: F.lit(None).cast(t) for c, t in missing.items()}
    filled["tags"] = F.array().cast("array<string>")
    filled.update(cols, source=F.lit(source), salary_currency=F.lit("USD"))
    filled["dedup_hash"] = dedup_hash(filled["title"], filled["company"])
    return df.select(*keep, *[c.alias(n) for n, c in filled.items()])


def _named(*names: str) -> EL.Test:
    return lambda tag: tag.name.isin(*names)


def _classed(*classes: str, names: tuple[str, ...] = ()) -> EL.Test:
    def test(tag: EL.Tag) -> Column:
        hit = EL.has_class(tag.classes, *classes)
        return tag.name.isin(*names) & hit if names else hit
    return test


def _places(cls: str) -> Column:
    """Indexes of a posting's pieces with a class; the posting's own tag is none of them."""
    at = F.transform("c", lambda x, i: F.when((i > 0) & EL.has_class(x, cls), i))
    return F.array_compact(at)


def _postings(pages: DataFrame, key: str, path: str, html: str) -> DataFrame:
    """``key, path, pos`` and pieces ``p``, names ``n`` and classes ``c`` of every posting link.

    One pass over the tags of a page keeps how deep it is in the jobs section, its
    articles and lists, and for every open item whether it has had its link.
    """
    staged = compute_once(pages.select(key, path, html), {"t": EL.pieces_of(F.col(html))})
    staged = compute_once(staged.drop(html), {"names": F.transform("t", EL.piece_name)})
    kinds = ("section", "article", "ul", "li")

    def event(name: Column, i: Column) -> Column:
        classes = EL.piece_classes(F.get("t", i))
        hit = F.when(name == "section", EL.has_class(classes, LIST_CLASS)).when(
            name == "a", EL.has_class(classes, *POSTING_CLASSES))
        wanted = name.isin(*kinds, *[f"/{k}" for k in kinds]) | ((name == "a") & hit)
        return F.when(wanted, F.struct(i.alias("at"), name.alias("name"), hit.alias("hit")))

    def step(acc: Column, e: Column) -> Column:
        name = e["name"]

        def depth(kind: str, within: Column, old: Column) -> Column:
            return (F.when(~within, 0).when(name == kind, old + 1)
                    .when(name == f"/{kind}", F.greatest(old - 1, F.lit(0))).otherwise(old))
        section = acc["section"] + (name == "section").cast("int") - (name == "/section").cast("int")
        jobs = (F.when((name == "section") & (acc["jobs"] == 0) & e["hit"], section)
                .when((name == "/section") & (acc["jobs"] > section), 0).otherwise(acc["jobs"]))
        article = depth("article", jobs > 0, acc["article"])
        ul = depth("ul", article > 0, acc["ul"])
        taken, none = acc["taken"], F.array().cast("array<boolean>")
        but_last = F.slice(taken, F.lit(1), F.greatest(F.size(taken) - 1, F.lit(0)))
        in_item = F.size(taken) > 0
        new = (name == "a") & in_item & ~F.try_element_at(taken, F.lit(-1))
        return F.struct(
            section.alias("section"), jobs.alias("jobs"), article.alias("article"), ul.alias("ul"),
            F.when(ul == 0, none).when(name == "li", F.array_append(taken, F.lit(False)))
            .when(name == "/li", but_last)
            .when(new, F.array_append(but_last, F.lit(True))).otherwise(taken).alias("taken"),
            F.when(new, F.array_append(acc["found"], e["at"])).otherwise(acc["found"]).alias("found"))
    zero = F.lit(0)
    start = F.struct(
        zero.alias("section"), zero.alias("jobs"), zero.alias("article"), zero.alias("ul"),
        F.array().cast("array<boolean>").alias("taken"), F.array().cast("array<int>").alias("found"))
    events = F.array_compact(F.transform("names", event))
    found = compute_once(staged, {"found": F.aggregate(events, start, step, lambda a: a["found"])})

    def link(at: Column) -> Column:
        rest = F.slice("names", at + 2, F.size("names"))
        ends = F.array_compact(F.array(*[F.nullif(F.array_position(rest, n), F.lit(0).cast("long"))
                                         for n in ("a", "/a")]))
        size = F.coalesce(F.array_min(ends).cast("int"), F.size("names"))
        return F.struct(at.alias("pos"), F.slice("t", at + 1, size).alias("p"),
                        F.slice("names", at + 1, size).alias("n"))
    rows = (found.select(key, path, F.explode(F.transform("found", link)).alias("link"))
            .select(key, path, "link.*"))
    return compute_once(rows, {"c": F.transform("p", EL.piece_classes)})


def parse_category_pages(pages: DataFrame, html: str = "html", path: str = "cat_path",
                         page_key: str = "page_id") -> DataFrame:
    """Postings of stored category pages in order of ``seq`` (the page) and ``pos``.

    A posting is the first posting link of an item of a list in an article of the jobs
    section; each field is the whole element of its class, the stripped texts joined.
    The first row per url stays. Titles and companies are required; a blank place falls back to a tag naming
    the whole world, then to "Remote".
    """
    source, base = CATEGORY_BOARD
    fields = compute_once(_postings(pages.select(page_key, path, html), page_key, path, html), {
        "href": EL.attribute(F.substring_index(F.get("p", F.lit(0)), ">", 1), "href"),
        **{n: EL.joined_pieces(EL.element_at(F.col("p"), F.col("n"), F.get(_places(c), F.lit(0))))
           for n, c in (("title", TITLE_CLASS), ("company", COMPANY_CLASS),
                        ("place", PLACE_CLASS))},
        "spans": F.transform(_places(SPAN_CLASS), lambda i: EL.joined_pieces(
            EL.element_at(F.col("p"), F.col("n"), i)))}).drop("p", "n", "c")
    fields = fields.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "company", "place")})
    usable = fields.where((F.col("href") != "") & ~F.col("href").startswith("javascript")
                          & (F.col("title") != "") & (F.col("company") != ""))
    job_type, tags = split_spans(F.col("spans"))
    category = blank_to_null(category_name(F.col(path)))
    all_tags = F.when(category.isNull(), tags).otherwise(F.array_append(tags, category))
    rows = _listing(
        usable.withColumn("seq", F.col(page_key)), ["seq", "pos"], source, title=F.col("title"),
        company=F.col("company"), url=resolve(F.col("href"), F.lit(base)),
        external_id=F.col("href"),
        location=F.coalesce(location_from_tags(F.col("place"), tags), F.lit(_REMOTE)),
        tags=all_tags, job_type=job_type)
    return keep_first(rows, ["url"], F.col("seq").asc(), F.col("pos").asc())


def parse_text_cards(cards: DataFrame, seq: str = "seq") -> DataFrame:
    """Cards of (href, text): line one is the title, line two the company."""
    source, base = TEXT_CARDS
    first = keep_first(cards.where(F.coalesce("href", F.lit("")) != ""), ["href"],
                       F.col(seq).asc())
    rows = (compute_once(first, {"_lines": stripped_lines(F.coalesce("text", F.lit("")))})
            .where(F.size("_lines") > 0)
            .withColumn("_title", F.try_element_at("_lines", F.lit(1))))
    rows = rows.where((F.length("_title") >= 4) & ~F.lower("_title").isin(*NAV_TITLES))
    line = F.col("_lines")
    lo, hi = parse_int_range(labelled_field(line, "Salary"))
    return _listing(
        rows, [seq], source, title=F.col("_title"),
        company=F.coalesce(F.try_element_at(line, F.lit(2)), F.lit(_UNKNOWN)),
        url=resolve(F.col("href"), F.lit(base)), external_id=F.col("href"),
        location=F.coalesce(labelled_field(line, "Location"), F.lit(_UNKNOWN)),
        job_type=labelled_field(line, "Employment Type"), salary_min=lo, salary_max=hi)


def parse_titled_cards(cards: DataFrame, seq: str = "seq", page: str | None = None) -> DataFrame:
    """Cards of (href, title, company, location), first per href (within a page, if given)."""
    source, base = TITLED_CARDS
    title = strip(F.coalesce("title", F.lit("")))
    usable = cards.where((F.coalesce("href", F.lit("")) != "") & (title != ""))
    first = keep_first(usable, [page, "href"] if page else ["href"], F.col(seq).asc())
    return _listing(
        first, [seq, *([page] if page else [])], source, title=title,
        company=F.coalesce(blank_to_null(strip(F.col("company"))), F.lit(_UNKNOWN)),
        url=resolve(F.col("href"), F.lit(base)), external_id=F.col("href"),
        location=F.coalesce(blank_to_null(strip(F.col("location"))), F.lit(_REMOTE)))


def _card_url(url: Column, base: str) -> Column:
    return F.coalesce(blank_to_null(absolutize(url, base)), F.lit(base))


def parse_board_cards(cards: DataFrame, seq: str = "seq") -> DataFrame:
    """Cards of (title, company, location, url); title and company are required."""
    source, base = BOARD_CARDS
    title, company, url = (strip(F.coalesce(c, F.lit(""))) for c in ("title", "company", "url"))
    rows = cards.where((title != "") & (company != ""))
    return _listing(rows, [seq], source, title=title, company=company, url=_card_url(url, base),
                    location=F.coalesce(blank_to_null(F.col("location")), F.lit(_REMOTE)))


def parse_link_cards(cards: DataFrame, seq: str = "seq") -> DataFrame:
    """Cards of (title, url), first per url as written; the company is unknown."""
    source, base = LINK_CARDS
    title, url = (strip(F.coalesce(c, F.lit(""))) for c in ("title", "url"))
    usable = cards.withColumns({"_title": title, "_url": url}).where(F.length("_title") >= 5)
    first = keep_first(usable, ["_url"], F.col(seq).asc())
    return _listing(first, [seq], source, title=F.left("_title", F.lit(200)),
                    company=F.lit(_UNKNOWN), url=_card_url(F.col("_url"), base),
                    location=F.lit(_REMOTE))


def parse_line_cards(cards: DataFrame, seq: str = "seq") -> DataFrame:
    """Cards of (title, url) whose text holds the title and the company on two lines."""
    source, base = LINE_CARDS
    title, url = (strip(F.coalesce(c, F.lit(""))) for c in ("title", "url"))
    rows = cards.withColumn("_title", title).where(F.length("_title") >= 5)
    job_title, company = split_title_company(F.col("_title"))
    return _listing(rows, [seq], source, title=job_title, company=company,
                    url=_card_url(url, base), location=F.lit(_REMOTE))


def _seen_in(text: str) -> EL.Test:
    return lambda tag: (tag.name == "a") & EL.attribute(tag.attrs, "href").contains(text)


def _class_has(*parts: str) -> EL.Test:
    """The class attribute contains one of ``parts`` anywhere."""
    return lambda tag: reduce(
        lambda a, b: a | b, [F.contains(tag.classes, F.lit(p)) for p in parts])


def titled_cards(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, seq, href, title, company, location`` of the job cards of stored pages.

    A card is a job element, an article or, where a link lies in none, its division; fields
    are the card's first heading or title, company and place, the link's text if it has no title.
    """
    def either(*tests: EL.Test) -> EL.Test:
        return lambda tag: reduce(lambda a, b: a | b, [t(tag) for t in tests])
    found = EL.cards(
        pages, key, html, [],
        either(_classed(*TITLED_CARD), _named("article", "div")),
        {"link": _seen_in("/jobs/"),
         "heading": either(_named("h2", "h3"), _classed(*TITLED_TITLE)),
         "company": _classed(*TITLED_COMPANY), "place": _classed(*TITLED_PLACE)},
        holding=_seen_in("/jobs/"))
    rows = compute_once(found, {
        "href": EL.attribute(F.get("link", F.lit(0))["attrs"], "href"),
        "title": F.left(F.coalesce(
            F.when(F.size("heading") > 0, EL.rendered(EL.first_of(F.col("heading")))),
            EL.rendered(EL.first_of(F.col("link")))), F.lit(200)),
        "company": EL.rendered(EL.first_of(F.col("company"))),
        "location": EL.rendered(EL.first_of(F.col("place")))})
    return (rows.where((F.size("link") > 0) & ~F.col("href").isin("/jobs", "/jobs/"))
            .select(key, F.col("at").alias("seq"), "href", "title", "company", "location"))


def board_cards(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, seq, title, company, location, url`` of the board's job elements.

    A job element is the innermost one around a company. The title is the posting link's text, else the first heading's.
    """
    def is_card(tag: EL.Tag) -> Column:
        return _class_has("JobListing", "job-card")(tag) | F.contains(
            EL.attribute(tag.attrs, "data-test"), F.lit("job"))
    found = EL.cards(pages, key, html, [], is_card, {
        "link": _seen_in("/jobs/"), "heading": _named("h2", "h3"),
        "company": _class_has("company", "Company"), "place": _class_has("location", "Location")},
        holding=_class_has("company", "Company"))
    title = F.when(F.size("link") > 0, EL.rendered(EL.first_of(F.col("link")))).otherwise(
        EL.rendered(EL.first_of(F.col("heading"))))
    url = F.coalesce(EL.attribute(F.get("link", F.lit(0))["attrs"], "href"), F.lit(""))
    return found.select(
        key, F.col("at").alias("seq"), title.alias("title"),
        EL.rendered(EL.first_of(F.col("company"))).alias("company"),
        EL.rendered(EL.first_of(F.col("place"))).alias("location"), url.alias("url"))


def link_cards(pages: DataFrame, key: str = "page_id", html: str = "html",
               path: str = "/job") -> DataFrame:
    """``key, seq, title, url`` of the posting links of stored pages, texts as lines."""
    found = EL.cards(pages, key, html, [], _seen_in(path), {})
    return found.select(key, F.col("at").alias("seq"),
                        F.left(EL.rendered(F.col("parts")), F.lit(200)).alias("title"),
                        EL.attribute(F.col("attrs"), "href").alias("url"))


def union_all(parts: list[DataFrame], rank: str | None = None) -> DataFrame:
    """UNION ALL in the given order; ``rank`` adds the position of the part."""
    numbered = [p if rank is None else p.withColumn(rank, F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
