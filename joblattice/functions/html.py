"""Stored HTML -> visible text, links, frames and cards, by regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip
from .urls import base_parts, resolve_parts

# Elements removed before reading the text.
AGGRESSIVE_TAGS = ("script", "style", "nav", "footer", "header", "noscript")
LIGHT_TAGS = ("script", "style", "noscript")
# Elements that break the line in rendered text.
BLOCK_TAGS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|form|h1|h2|h3|h4|h5|h6|"
    "hr|li|main|ol|option|p|pre|section|table|td|th|tr|ul"
)
# Named entities decoded to text; the ampersand itself comes last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&#39;", "'"), ("&#x27;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"),
    ("&raquo;", "»"), ("&amp;", "&"),
)
# An attribute name follows white space or a quote, so ``data-href`` is none; its value is
# quoted either way or bare.
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ANCHOR = r"""(?is)<a\s(?:[^>]*?[\s"'])??href""" + _VALUE + r"[^>]*>(.*?)</a>"
FRAME = r"""(?is)<iframe\s(?:[^>]*?[\s"'])??src""" + _VALUE
UNRENDERED = r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>"
TAG = r"(?s)<[^>]*>"


def decode_entities(c: Column) -> Column:
    """Named entities as text; texts without an ampersand are left alone."""
    return let(c, lambda v: F.when(F.contains(v, F.lit("&")), reduce(
        lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), ENTITIES, v)).otherwise(v))


def _text_without(html: Column, tags: tuple[str, ...]) -> Column:
    """Remove elements, break lines at block tags, drop the other tags.

    The head, comments and raw-text elements go in one left-to-right pass, so a
    tag inside a script is never taken for markup; page furniture follows.
    """
    raw = [t for t in tags if t in LIGHT_TAGS]
    furniture = [t for t in tags if t not in LIGHT_TAGS]
    body = F.regexp_replace(
        html, rf"(?is)<head\b.*?</head>|<!--.*?-->|<({'|'.join(raw)})\b.*?</\1\s*>", "")
    if furniture:
        body = F.regexp_replace(body, rf"(?is)<({'|'.join(furniture)})\b.*?</\1\s*>", "")
    broken = F.regexp_replace(body, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    return decode_entities(F.regexp_replace(broken, TAG, ""))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and page furniture (nav, header, footer)."""
    return _text_without(html, AGGRESSIVE_TAGS)


def light_text(html: Column) -> Column:
    """Text without scripts and styles only; for pages whose content sits in the furniture."""
    return _text_without(html, LIGHT_TAGS)


def inner_text(fragment: Column) -> Column:
    return strip(decode_entities(F.regexp_replace(fragment, TAG, "")))


def _unquoted(value: Column) -> Column:
    """An attribute value without the quotes it was written in."""
    quoted = F.left(value, F.lit(1)).isin('"', "'")
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def anchors(html: Column) -> Column:
    """``array<struct<href, text>>`` of all anchors, href as written.

    Anchors inside comments, scripts, styles and noscript are no anchors.
    """
    def found(markup: Column) -> Column:
        hrefs = F.regexp_extract_all(markup, F.lit(ANCHOR), F.lit(1))
        bodies = F.regexp_extract_all(markup, F.lit(ANCHOR), F.lit(2))
        return F.zip_with(hrefs, bodies, lambda h, b: F.struct(
            strip(decode_entities(_unquoted(h))).alias("href"), inner_text(b).alias("text")))
    return let(F.regexp_replace(html, UNRENDERED, ""), found)


def first_per_href(links: Column) -> Column:
    """Keep the first entry of every href, order preserved."""
    return let(links, lambda v: let(F.transform(v, lambda x: x["href"]), lambda hrefs: F.filter(
        v, lambda x, i: F.array_position(hrefs, x["href"]) == i + 1)))


def page_links(anchor_array: Column, base: Column) -> Column:
    """Absolute links, one per href, text cut to 200 characters."""
    usable = F.filter(anchor_array, lambda a: (a["href"] != "") & (a["href"] != "#")
                      & ~a["href"].startswith("javascript"))
    absolute = let(base_parts(base), lambda b: F.transform(usable, lambda a: F.struct(
        resolve_parts(a["href"], b).alias("href"), F.left(a["text"], F.lit(200)).alias("text"))))
    return first_per_href(absolute)


def frames(html: Column) -> Column:
    markup = F.regexp_replace(html, UNRENDERED, "")
    return F.transform(F.regexp_extract_all(markup, F.lit(FRAME), F.lit(1)),
                       lambda s: decode_entities(_unquoted(s)))


def job_cards(anchor_array: Column) -> Column:
    """Anchors below ``/jobs/`` other than the index page; text cut to 600 characters."""
    wanted = F.filter(anchor_array, lambda a: F.contains(a["href"], F.lit("/jobs/"))
                      & ~a["href"].isin("/jobs", "/jobs/"))
    return F.transform(wanted, lambda a: F.struct(
        a["href"].alias("href"), F.left(a["text"], F.lit(600)).alias("text")))


def is_blocked(html: Column) -> Column:
    """Challenge and captcha pages."""
    low = F.lower(html)
    title = F.regexp_extract(low, r"(?s)<title[^>]*>(.*?)</title>", 1)
    return (F.contains(low, F.lit("captcha")) | F.contains(low, F.lit("challenge"))
            | F.contains(title, F.lit("just a moment")))
