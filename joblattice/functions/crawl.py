"""Crawl record predicates: success, error labels and categories, link filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import first_per_href
from .text import let, strip
from .urls import (AUTH_PATH, JOBS_PATH, JOBS_PHRASE, base_parts, is_ats_host,
                   resolve_parts, url_path)

# Error categories, first match wins.
ERROR_CATEGORIES = (
    ("captcha_or_login_wall", r"(?iU)captcha|cloudflare|access denied|forbidden|403|sign[- ]?in"
                              r"|log[- ]?in|verify you are human|just a moment"),
    ("connection_refused", r"(?iU)connection.*(refused|reset|closed)|ECONNREFUSED|ECONNRESET"
                           r"|net::ERR_CONNECTION"),
    ("dns_error", r"(?iU)name not resolved|getaddrinfo|net::ERR_NAME|ENOTFOUND|DNS"),
    ("ssl_error", r"(?iU)SSL|TLS|certificate|net::ERR_CERT"),
    ("redirect_loop", r"(?iU)too many redirects|net::ERR_TOO_MANY_REDIRECTS|redirect loop"),
    ("http_404", r"(?iU)\b404\b|not found|page not found"),
    ("http_5xx", r"(?iU)\b5\d\d\b|server error|bad gateway|gateway timeout|service unavailable"),
    ("timeout_total", r"(?iU)total timeout exceeded"),
    ("timeout_navigation", r"(?iU)timeout.*navigat|net::ERR_TIMED_OUT|Timeout \d+ms exceeded"),
    ("aborted", r"(?iU)net::ERR_ABORTED|aborted"),
    ("insufficient_content", r"(?iU)insufficient_content"),
)
# Link noise (social, legal and account targets).
LINK_NOISE = (
    r"(?i)(mailto:|javascript:|tel:|"
    r"(?:twitter|x|facebook|instagram|youtube|linkedin|bsky|tiktok|threads|pinterest|reddit|"
    r"medium)\.com|bsky\.app|t\.me|discord\.(?:gg|com)|"
    r"/(?:cookie|privacy|terms|legal|accessibility|gdpr|imprint|login|signin|sign-in|sign_in|"
    r"logout|subscribe|newsletter))"
)
# The same targets, anchored at the host of an absolute url (``strict=True``).
LINK_NOISE_STRICT = (
    r"(?i)(^mailto:|^javascript:|^tel:|^(?:https?:)?//(?:[^/]*\.)?"
    r"(?:(?:twitter|x|facebook|instagram|youtube|linkedin|bsky|tiktok|threads|pinterest|reddit|"
    r"medium)\.com|bsky\.app|t\.me|discord\.(?:gg|com))(?:[/:?#]|$)|"
    r"/(?:cookie|privacy|terms|legal|accessibility|gdpr|imprint|login|signin|sign-in|sign_in|"
    r"logout|subscribe|newsletter))"
)
# Words that mark a link as a job posting; the page matcher also knows "admin".
JOB_WORDS_PAGE = (
    r"(?i)(analyst|specialist|engineer|manager|lead|director|coordinator|associate|officer|"
    r"developer|architect|admin|accountant|operation|finance|data|reconcil|settle|trade|report|"
    r"automat|python|support)"
)
JOB_WORDS_LISTING = (
    r"(?i)(analyst|specialist|engineer|manager|lead|director|coordinator|associate|officer|"
    r"developer|architect|accountant|operation|finance|data|reconcil|settle|trade|report|"
    r"automat|python|support)"
)
# Url shapes of single postings, and words that disqualify a link.
ATS_POSTING = (
    r"(?i)(greenhouse\.io/.+/jobs/|lever\.co/.+/|ashbyhq\.com/.+/|"
    r"myworkdayjobs\.com/.+/job/|workable\.com/.+/j/|bamboohr\.com/careers/|/jobs?/\d|"
    r"/positions?/\d|/careers/.+/\d)"
)
SKIP_WORDS = ("login", "sign in", "privacy", "cookie", "terms of")


def _any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def is_success(error: Column, text: Column) -> Column:
    return (F.coalesce(error, F.lit("")) == "") & (F.coalesce(text, F.lit("")) != "")


def is_failure(error: Column) -> Column:
    return F.coalesce(error, F.lit("")) != ""


def status_error_label(status: Column) -> Column:
    return (F.when(status == 404, F.lit("http_404 page not found"))
            .when(status == 403, F.lit("http_403 forbidden"))
            .when(status == 401, F.lit("http_401 unauthorized"))
            .when(status.between(500, 599),
                  F.concat(F.lit("http_"), status.cast("string"), F.lit(" server error"))))


def error_message(c: Column) -> Column:
    """First line, at most 300 characters."""
    return F.left(F.substring_index(c, "\n", 1), F.lit(300))


def categorize(error: Column) -> Column:
    start = F.when(~is_failure(error), F.lit("ok"))
    chain = reduce(lambda acc, p: acc.when(error.rlike(p[1]), F.lit(p[0])),
                   ERROR_CATEGORIES, start)
    return chain.otherwise(F.lit("other"))


def min_chars(status: Column, url: Column) -> Column:
    """Least text length accepted for a page."""
    healthy = F.coalesce((status < 400) & (status != 0), F.lit(False))
    return (F.when(healthy & is_ats_host(url), 50).when(healthy, 100).otherwise(200))


def choose_text(aggressive: Column, light: Column, status: Column) -> Column:
    """Fall back to the lightly stripped text when the aggressive one is too short."""
    healthy = F.coalesce((status < 400) & (status != 0), F.lit(False))
    enough = F.length(light) >= F.when(healthy, 100).otherwise(200)
    return F.when((F.length(aggressive) < 200) & enough, light).otherwise(aggressive)


def drop_noise_links(links: Column, strict: bool = False) -> Column:
    """Drop blank, short, in-page, social, legal and account links; first per href."""
    pattern = LINK_NOISE_STRICT if strict else LINK_NOISE
    tidy = F.transform(links, lambda x: F.struct(
        strip(F.coalesce(x["text"], F.lit(""))).alias("text"),
        strip(F.coalesce(x["href"], F.lit(""))).alias("href")))
    kept = F.filter(tidy, lambda x: (x["href"] != "") & (F.length(x["text"]) >= 3)
                    & ~x["href"].startswith("#") & ~x["href"].rlike(pattern))
    return first_per_href(kept)


def relevant_page_links(links: Column, exclude_keywords) -> Column:
    """Posting links of a matched page as ``array<struct<title, url>>``."""
    def keep(x):
        text, href = F.coalesce(x["text"], F.lit("")), F.coalesce(x["href"], F.lit(""))
        both = F.lower(F.concat(text, F.lit(" "), href))
        return ((F.length(text) >= 3) & ~_any_of(both, SKIP_WORDS)
                & (text.rlike(JOB_WORDS_PAGE) | href.rlike(ATS_POSTING))
                & ~_any_of(both, [k.lower() for k in exclude_keywords]))
    return F.transform(F.filter(links, keep), lambda x: F.struct(
        strip(x["text"]).alias("title"), x["href"].alias("url")))


def is_listing_link(text: Column, href: Column) -> Column:
    """Posting link test of the unified matcher (text only, no ``admin``)."""
    t, h = F.coalesce(text, F.lit("")), F.coalesce(href, F.lit(""))
    return ((F.length(t) >= 5) & (h != "")
            & ~_any_of(F.lower(F.concat(t, h)), SKIP_WORDS) & t.rlike(JOB_WORDS_LISTING))


def best_jobs_url(frame_srcs: Column, anchor_array: Column, base: Column) -> Column:
    """Best page to visit for open positions, NULL when the page offers none.

    Preference: board frame, board link, "see jobs" link text, jobs path.
    """
    frame = F.try_element_at(F.filter(frame_srcs, is_ats_host), F.lit(1))
    frame_url = F.when(frame.startswith("//"), F.concat(F.lit("https:"), frame)).otherwise(frame)
    usable = F.filter(anchor_array, lambda a: (a["href"] != "") & ~a["href"].startswith("#")
                      & ~a["href"].startswith("javascript"))
    full = let(base_parts(base), lambda b: F.transform(usable, lambda a: F.struct(
        resolve_parts(a["href"], b).alias("url"), a["text"].alias("text"))))

    def open_path(a):
        return ~url_path(a["url"]).rlike(AUTH_PATH)

    def pick(links: Column) -> Column:
        def first(test):
            return F.try_element_at(F.filter(links, test), F.lit(1))["url"]
        return F.coalesce(
            frame_url,
            first(lambda a: is_ats_host(a["url"])),
            first(lambda a: open_path(a) & a["text"].rlike(JOBS_PHRASE)),
            first(lambda a: open_path(a) & url_path(a["url"]).rlike(JOBS_PATH)))
    return let(full, pick)
