"""URL resolution, parts and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, let

# Hosts of known applicant tracking systems.
ATS_HOST = (
    r"(?i)(boards\.greenhouse\.io|job-boards\.greenhouse\.io|[\w-]+\.greenhouse\.io|"
    r"jobs\.lever\.co|[\w-]+\.myworkdayjobs\.com|myworkdayjobs\.com|app\.dover\.io|"
    r"jobs\.ashbyhq\.com|[\w-]+\.ashbyhq\.com|apply\.workable\.com|jobs\.workable\.com|"
    r"[\w-]+\.bamboohr\.com|(?:careers|jobs)\.smartrecruiters\.com|jobs\.jobvite\.com|"
    r"[\w-]+\.jobvite\.com|[\w-]+\.recruitee\.com|[\w-]+\.teamtailor\.com|[\w-]+\.breezy\.hr|"
    r"jobs\.personio\.com|jobs\.personio\.de|[\w-]+\.jobs\.personio\.com|"
    r"[\w-]+\.applytojob\.com|[\w-]+\.comeet\.co|[\w-]+\.zohorecruit\.com|"
    r"[\w-]+\.pinpointhq\.com|[\w-]+\.bullhorncareers\.com|[\w-]+\.icims\.com|"
    r"[\w-]+\.taleo\.net|[\w-]+\.successfactors\.com|[\w-]+\.eightfold\.ai|"
    r"app\.beamery\.com|[\w-]+\.beamery\.com|freshteam\.com/jobs|[\w-]+\.freshteam\.com|"
    r"join\.com/companies)"
)
# Account and login paths.
AUTH_PATH = (
    r"(?i)/(register|signup|sign[-_]?up|signin|sign[-_]?in|login|log[-_]?in|logout|account|"
    r"auth|sso|oauth|verify|forgot|reset)(/|$|\?)"
)
# Paths and anchor texts that lead to an index of open positions.
JOBS_PATH = (
    r"(?i)/(jobs|positions|openings|vacancies|opportunities|"
    r"careers/(search|listings|jobs|open|all|positions|browse|view)|"
    r"join|work-with-us|join-us|hiring|join-our-team)(/|$|\?)"
)
JOBS_PHRASE = (
    r"(?iU)(see|view|browse|search|explore|find|open|all|current|available)\s+"
    r"(?:our\s+)?(jobs|positions|roles|openings|opportunities|vacancies)"
)
# Embedded board address and its canonical form.
EMBED_BOARD = r"(?i)greenhouse\.io/embed/job_board[^#]*?[?&]for=([\w.-]+)"
EMBED_CANONICAL = "https://job-boards.greenhouse.io/"

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_authority(c: Column) -> Column:
    """Lower-cased ``[user@]host[:port]``, blank when there is none."""
    return F.lower(F.coalesce(F.regexp_extract(c, _URL, 2), F.lit("")))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, _URL, 3)


def href_path(href: Column, base: Column) -> Column:
    """Path of a resolved link, ``/`` when blank."""
    return F.coalesce(blank_to_null(url_path(resolve(href, base))), F.lit("/"))


def is_ats_host(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(ATS_HOST)


def is_auth_path(path: Column) -> Column:
    return path.rlike(AUTH_PATH)


def absolutize(url: Column, base_url: str) -> Column:
    """Prefix the site address unless the url is blank or starts with ``http``."""
    return F.when((url == "") | url.startswith("http"), url).otherwise(
        F.concat(F.lit(base_url), url))


def pick_site_url(careers: Column, website: Column) -> Column:
    """Careers page, else website, with ``https://`` added where no scheme is given."""
    url = F.coalesce(blank_to_null(careers), blank_to_null(website))
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def canonical_board_url(c: Column) -> Column:
    """Embedded board address -> canonical board address, NULL for any other url."""
    slug = F.regexp_extract(c, EMBED_BOARD, 1)
    return F.when(slug != "", F.concat(F.lit(EMBED_CANONICAL), slug))


def _without_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            segments, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1),
                                                     F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc).otherwise(F.array_append(acc, s)))
        is_folder = F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0)
        return F.concat(F.lit("/"), F.array_join(kept, "/"),
                        F.when(is_folder, F.lit("/")).otherwise(F.lit("")))
    return let(F.split(F.substr(path, F.lit(2)), "/"), fold)


def base_parts(base: Column) -> Column:
    """What resolving needs of a page address: itself, ``scheme://host``, path, folder, query."""
    root = F.concat(F.regexp_extract(base, _URL, 1), F.lit("://"), F.regexp_extract(base, _URL, 2))
    path = F.regexp_extract(base, _URL, 3)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return F.struct(base.alias("url"), root.alias("root"), path.alias("path"),
                    folder.alias("folder"), F.regexp_extract(base, r"\?[^#]*", 0).alias("query"))


def resolve_parts(href: Column, b: Column) -> Column:
    """``resolve`` against a page address already taken apart."""
    path = F.regexp_extract(href, r"(?s)^[^?#]*", 0)
    rest = F.substr(href, F.length(path) + 1)
    target = F.when(href.startswith("/"), path).otherwise(F.concat(b["folder"], path))
    plain = F.concat(b["root"], target, rest)
    dotted = F.concat(b["root"], _without_dots(target), rest)
    return (F.when(href.startswith("//"), F.concat(F.lit("https:"), href))
            .when(href.startswith("http") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href == "", b["url"])
            .when(href.startswith("#"), F.concat(b["root"], b["path"], b["query"], href))
            .when(href.startswith("?"), F.concat(b["root"], b["path"], href))
            .when(target.rlike(r"/\.\.?(/|$)"), dotted)
            .otherwise(plain))


def resolve(href: Column, base: Column) -> Column:
    """Resolve a link against its page (RFC 3986), ``//host`` becoming https."""
    return let(base_parts(base), lambda b: resolve_parts(href, b))
