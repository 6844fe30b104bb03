"""Text helpers and listing normalisers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# What ends a line, longest first.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Bracketed title noise.
TITLE_NOISE = (
    r"(?iU)\s*[\(\[].*(remote|hybrid|contract|full[- ]?time|part[- ]?time|m/f/d|m/w/d|h/f"
    r"|all genders).*[\)\]]"
)
# Experience level patterns, first match wins.
EXPERIENCE_PATTERNS = (
    ("junior", r"(?iU)\b(junior|jr\.?|entry[- ]?level|associate)\b"),
    ("mid", r"(?iU)\b(mid[- ]?level|intermediate)\b"),
    ("senior", r"(?iU)\b(senior|sr\.?|principal|staff)\b"),
    ("lead", r"(?iU)\b(lead|head|director|vp|chief|manager)\b"),
)
# Canonical locations, also reached through a "remote - " prefix.
LOCATION_NAMES = {
    "worldwide": "Remote (Worldwide)",
    "anywhere": "Remote (Worldwide)",
    "global": "Remote (Worldwide)",
    "remote": "Remote",
}
# Canonical job types.
JOB_TYPES = {
    "full_time": "full-time",
    "full time": "full-time",
    "fulltime": "full-time",
    "part_time": "part-time",
    "part time": "part-time",
    "parttime": "part-time",
    "freelance": "contract",
    "contractor": "contract",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda that refers to an outer expression evaluates it again for every
    element; bound here it becomes a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim all Unicode whitespace (``trim`` alone removes only spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def stripped_lines(c: Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(lines(c), strip), lambda s: s != "")


def split_list(c: Column, sep: str = ",") -> Column:
    """``"a, b,,c"`` -> ``[a, b, c]``."""
    return F.filter(F.transform(F.split(c, sep), strip), lambda s: s != "")


def title_case(c: Column) -> Column:
    """Capitalise every run of letters; digits and punctuation start a new run."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))),
                                                 F.lower(F.substr(r, F.lit(2)))))
    return F.array_join(cased, "")


def dedup_hash(title: Column, company: Column) -> Column:
    normalised = F.concat(strip(F.lower(title)), F.lit("|"), strip(F.lower(company)))
    return F.left(F.sha2(normalised, 256), F.lit(16))


def normalize_title(c: Column) -> Column:
    cleaned = F.regexp_replace(c, TITLE_NOISE, "")
    return strip(F.regexp_replace(cleaned, r"(?U)\s+", " "))


def normalize_tags(tags: Column) -> Column:
    cleaned = F.transform(tags, lambda t: F.lower(strip(t)))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def normalize_location(c: Column) -> Column:
    loc = strip(c)
    low = F.lower(loc)
    expr = F.when(loc == "", F.lit("Remote"))
    for name, canonical in LOCATION_NAMES.items():
        expr = expr.when(low.isin(name, f"remote - {name}"), F.lit(canonical))
    return expr.when(~F.contains(low, F.lit("remote")),
                     F.concat(F.lit("Remote ("), loc, F.lit(")"))).otherwise(loc)


def _first_level(c: Column) -> Column:
    return reduce(lambda acc, p: acc.when(c.rlike(p[1]), F.lit(p[0])),
                  EXPERIENCE_PATTERNS[1:],
                  F.when(c.rlike(EXPERIENCE_PATTERNS[0][1]), F.lit(EXPERIENCE_PATTERNS[0][0])))


def experience_level(title: Column, description: Column) -> Column:
    """Level named in the title, else in the first 500 characters of the description."""
    head = F.left(F.coalesce(description, F.lit("")), F.lit(500))
    return F.coalesce(_first_level(title), _first_level(head))


def normalize_job_type(c: Column) -> Column:
    key = strip(F.lower(c))
    expr = F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
    for name, canonical in JOB_TYPES.items():
        expr = expr.when(key == name, F.lit(canonical))
    return expr.otherwise(key)


def clean_text(c: Column) -> Column:
    """Right-trim lines, squeeze blank runs and inner runs of blanks, strip the whole."""
    trimmed = F.transform(lines(c), rstrip)
    squeezed = F.transform(trimmed, lambda s: F.regexp_replace(s, "[ \t]{2,}", " "))
    joined = F.array_join(squeezed, "\n")
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def labelled_field(lines_col: Column, label: str) -> Column:
    """The line after the first line equal to ``label`` (case-insensitive)."""
    def pick(v: Column) -> Column:
        found = F.filter(v, lambda s, i: (F.lower(s) == label.lower()) & (i + 1 < F.size(v)))
        at = F.array_position(v, F.try_element_at(found, F.lit(1)))
        return F.try_element_at(v, F.when(at > 0, at.cast("int") + 1))
    return let(lines_col, pick)


def append_if_absent(tags: Column, value: Column) -> Column:
    keep = (F.coalesce(value, F.lit("")) == "") | F.array_contains(tags, value)
    return F.when(F.coalesce(keep, F.lit(False)), tags).otherwise(F.array_append(tags, value))


def split_spans(spans: Column) -> tuple[Column, Column]:
    """Category labels -> (job type, tags): "featured" is dropped, the last type wins."""
    types = F.filter(F.transform(spans, F.lower),
                     lambda s: s.isin("full-time", "part-time", "contract", "freelance"))
    tags = F.filter(spans, lambda s: ~F.lower(s).isin(
        "featured", "full-time", "part-time", "contract", "freelance"))
    return F.try_element_at(types, F.lit(-1)), tags


def location_from_tags(location: Column, tags: Column) -> Column:
    """A blank location falls back to the first tag naming the whole world."""
    hits = F.filter(tags, lambda t: F.contains(F.lower(t), F.lit("anywhere"))
                    | F.contains(F.lower(t), F.lit("world")))
    return F.coalesce(blank_to_null(location), F.try_element_at(hits, F.lit(1)))


def category_name(path: Column) -> Column:
    """``/categories/remote-data-jobs`` -> ``Data``."""
    slug = F.element_at(F.split(path, "/"), -1)
    for old, new in (("remote-", ""), ("-jobs", ""), ("-", " ")):
        slug = F.replace(slug, F.lit(old), F.lit(new))
    return title_case(slug)


def name_from_stem(stem: Column) -> Column:
    return title_case(F.replace(stem, F.lit("-"), F.lit(" ")))


def split_title_company(c: Column) -> tuple[Column, Column]:
    """First text line is the title, the second the company."""
    parts = F.split(c, "\n")
    company = F.when(F.size(parts) > 1, strip(F.try_element_at(parts, F.lit(2))))
    return strip(F.element_at(parts, 1)), F.coalesce(company, F.lit("Unknown"))


def markdown_row(title: Column, url: Column, company: Column, location: Column,
                 salary: Column, source: Column) -> Column:
    place = F.coalesce(blank_to_null(location), F.lit("—"))
    return F.format_string("| [%s](%s) | %s | %s | %s | %s |",
                           title, url, company, place, salary, source)
