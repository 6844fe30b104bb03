"""Hand-derived cases of the scalar functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from joblattice.functions import crawl as CR
from joblattice.functions import dates as D
from joblattice.functions import html as H
from joblattice.functions import money as M
from joblattice.functions import scoring as SC
from joblattice.functions import text as T
from joblattice.functions import urls as U
from joblattice.functions.similarity import allowed_indel, lcs_length_udf, sorted_tokens


def test_strip_removes_unicode_whitespace(values):
    assert values(T.strip, [" \t a b  \n", ""]) == ["a b", ""]


def test_title_case_restarts_after_every_non_letter(values):
    assert values(T.title_case, ["3d o'neil foo-bar", "ÉLAN vital"]) == ["3D O'Neil Foo-Bar", "Élan Vital"]


def test_dedup_hash(values):
    want = hashlib.sha256("data engineer|acme".encode()).hexdigest()[:16]
    assert values(lambda c: T.dedup_hash(c, F.lit("ACME")), [" Data Engineer "]) == [want]


def test_normalize_title(values):
    got = values(T.normalize_title, ["Data Engineer (Remote, EU)", "Data  Engineer (Platform)", " Dev [m/w/d] "])
    assert got == ["Data Engineer", "Data Engineer (Platform)", "Dev"]


def test_normalize_tags(values):
    got = values(T.normalize_tags, [[" SQL", "sql", "", "Spark"]], "array<string>")
    assert got == [["sql", "spark"]]


def test_normalize_location(values):
    got = values(T.normalize_location, ["", "anywhere", "Remote - Global", "Berlin", "Remote (EU)", "remote"])
    assert got == ["Remote", "Remote (Worldwide)", "Remote (Worldwide)", "Remote (Berlin)", "Remote (EU)", "Remote"]


def test_experience_level_order_and_fallback(values):
    assert values(lambda c: T.experience_level(c, F.lit(None).cast("string")),
                  ["Associate Director", "Sr. Dev", "Engineer", "Teamlead"]) == ["junior", "senior", None, None]
    assert values(lambda c: T.experience_level(F.lit("Engineer"), c),
                  ["we need a senior hand", "x" * 500 + " senior"]) == ["senior", None]


def test_job_type(values):
    got = values(T.normalize_job_type, ["Full_Time", "freelance", "Internship", "", None])
    assert got == ["full-time", "contract", "internship", None, None]


def test_parse_amount(values):
    assert values(M.parse_amount, ["$60,000", "n/a", None, "12.5", " 7 "]) == [60000, None, None, None, 7]


@pytest.mark.parametrize("text,want", [
    ("$60k - $90k", (60000, 90000)), ("$60,000 - $90,000", (60000, 90000)),
    ("$1,000 - $1,200 per week", (1000000, 1200000)), ("$1,000 - $1,200 per month", (1000, 1200)),
    ("$900 - $1,200", (900000, 1200000)), ("competitive", (None, None)), ("1.2.3 - 4", (None, None))])
def test_parse_k_range(values, text, want):
    got = values(lambda c: F.struct(*[p.alias(n) for p, n in zip(M.parse_k_range(c), ("lo", "hi"))]), [text])
    assert (got[0]["lo"], got[0]["hi"]) == want


def test_parse_int_range(values):
    got = values(lambda c: F.concat_ws("/", *[p.cast("string") for p in M.parse_int_range(c)]),
                 ["$120,000 – $150,000", "120k - 150k"])
    assert got == ["120000/150000", ""]


def test_salary_display(values):
    def show(c):
        return M.salary_display(c, F.lit(2000).cast("bigint"))
    assert values(show, [1500, None, 0], "bigint") == ["$1,500 - $2,000", "? - $2,000", "? - $2,000"]
    assert values(lambda c: M.salary_display(c, c), [0, None], "bigint") == ["", ""]


def test_iso_dates(values):
    raw = ["2024-01-01T10:00:00Z", "2024-01-01", "2024-01-01 08:30:00.5+02:00", "soon", "2024-13-01", None]
    assert values(D.iso_keep_offset, raw) == [
        "2024-01-01T10:00:00+00:00", "2024-01-01T00:00:00", "2024-01-01T08:30:00.500000+02:00", "soon",
        "2024-13-01", None]
    assert values(D.iso_as_utc, raw[:3]) == [
        "2024-01-01T10:00:00+00:00", "2024-01-01T00:00:00+00:00", "2024-01-01T08:30:00.500000+00:00"]


@pytest.mark.parametrize("href,base,want", [
    ("//a.io/x", "http://h/p", "https://a.io/x"), ("httpfoo", "http://h/p", "httpfoo"),
    ("/r?q=1#f", "https://h.com/a/b?c=d", "https://h.com/r?q=1#f"), ("x", "https://h.com/a/b", "https://h.com/a/x"),
    ("x", "https://h.com", "https://h.com/x"), ("../x", "https://h.com/a/b/c", "https://h.com/a/x"),
    ("../../../x", "https://h.com/a/b", "https://h.com/x"), ("./", "https://h.com/a/b", "https://h.com/a/"),
    ("?q=2", "https://h.com/a/b?x=1", "https://h.com/a/b?q=2"), ("#top", "https://h.com/a?x=1", "https://h.com/a?x=1#top"),
    ("", "https://h.com/a", "https://h.com/a"), ("mailto:a@b", "https://h.com/a", "mailto:a@b"),
    ("a/./b/../c", "https://h.com/d/e", "https://h.com/d/a/c")])
def test_resolve(values, href, base, want):
    from urllib.parse import urljoin
    assert values(lambda c: U.resolve(c, F.lit(base)), [href]) == [want]
    if not href.startswith(("http", "//")) and href != "":
        assert urljoin(base, href) == want


def test_url_parts(values):
    assert values(U.url_authority, ["https://U@H.com:80/x", "no url", "//h/x"]) == ["u@h.com:80", "", "h"]
    assert values(lambda c: U.href_path(c, F.lit("https://h.com")), ["?a", "/register?returnUrl=/jobs"]) == ["/", "/register"]
    assert values(lambda c: U.is_auth_path(c), ["/login", "/Sign_Up/x", "/authors", "/jobs"]) == [True, True, False, False]
    assert values(lambda c: U.is_ats_host(c), ["https://x.breezy.hr/", "https://jobs.lever.co/a", "https://a.b", None]) == [
        True, True, False, False]


def test_canonical_board(values):
    got = values(U.canonical_board_url, ["https://boards.greenhouse.io/embed/job_board?for=foo&x=1", "https://a.b"])
    assert got == ["https://job-boards.greenhouse.io/foo", None]


def test_labelled_field(values):
    got = values(lambda c: T.labelled_field(c, "Location"),
                 [["T", "C", "location", "Oslo"], ["Location"], ["T"], []], "array<string>")
    assert got == ["Oslo", None, None, None]


def test_clean_text(values):
    assert values(T.clean_text, ["a  \n\n\n\nb\t\tc ", "\r\n x y"]) == ["a\n\nb c", "x\ny"]


def test_status_labels(values):
    got = values(CR.status_error_label, [None, 200, 401, 403, 404, 502], "bigint")
    assert got == [None, None, "http_401 unauthorized", "http_403 forbidden", "http_404 page not found",
                   "http_502 server error"]


def test_categories(values):
    cases = {
        None: "ok", "": "ok", "http_401 unauthorized": "other", "total timeout exceeded": "timeout_total",
        "timeout navigating to page: net::ERR_TOO_MANY_REDIRECTS": "redirect_loop",
        "http_403 forbidden": "captcha_or_login_wall", "page at /login gone": "captcha_or_login_wall",
        "http_404 page not found": "http_404", "http_404": "other", "error 404": "http_404",
        "net::ERR_CONNECTION_RESET": "connection_refused", "getaddrinfo failed": "dns_error",
        "certificate expired": "ssl_error", "http_503 server error": "http_5xx",
        "Timeout 25000ms exceeded": "timeout_navigation", "net::ERR_ABORTED": "aborted",
        "insufficient_content": "insufficient_content"}
    assert values(CR.categorize, list(cases)) == list(cases.values())


def test_error_message(values):
    assert values(CR.error_message, ["a\nb", "x" * 400]) == ["a", "x" * 300]


def test_content_floor(values):
    def accept(c):
        return CR.min_chars(c, F.lit("https://jobs.lever.co/x"))
    assert values(accept, [200, 404, None, 0], "bigint") == [50, 200, 200, 200]
    assert values(lambda c: CR.min_chars(c, F.lit("https://a.b")), [200], "bigint") == [100]


def test_link_noise(values):
    links = [[("Jobs page", "https://netflix.com/jobs"), ("ok page", "https://a.com/1"), ("again", "https://a.com/1"),
              ("no", "https://a.com/2"), ("In page", "#top"), ("Mail me", "mailto:x")]]
    kind = "array<struct<text:string,href:string>>"
    assert [x["href"] for x in values(CR.drop_noise_links, links, kind)[0]] == ["https://a.com/1"]
    strict = values(lambda c: CR.drop_noise_links(c, strict=True), links, kind)[0]
    assert [x["href"] for x in strict] == ["https://netflix.com/jobs", "https://a.com/1"]


def test_roles_and_words(values):
    assert values(lambda c: SC.has_role(c, "Data Analyst"), ["senior data person", "dat anal"]) == [True, False]
    assert values(lambda c: SC.has_role(c, "QA of"), ["qa of"]) == [False]
    assert values(lambda c: SC.has_word(c, "sql"), ["postgresql", "sql,", "ésql", "(sql)"]) == [False, True, False, True]
    # A term ending in symbols needs a following word character.
    assert values(lambda c: SC.has_word(c, "C++"), ["c++ dev", "c++x"]) == [False, True]


def test_visible_text(values):
    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/x'>menu</a></nav>"
            "<script>var t='</p><p>no';</script><h1>Head &amp; more</h1><p><b>one<br>two</p><!-- <p>no</p> -->"
            "<noscript>no</noscript><footer>foot</footer></body></html>")
    assert values(lambda c: T.clean_text(H.visible_text(c)), [page]) == ["Head & more\n\none\ntwo"]
    assert values(lambda c: T.clean_text(H.light_text(c)), [page]) == ["menu\nHead & more\n\none\ntwo\nfoot".replace("menu\n", "menu\n")]


def test_best_jobs_url_preference(values):
    base = "https://h.com/a"

    def best(c):
        return CR.best_jobs_url(H.frames(c), H.anchors(c), F.lit(base))
    frame = '<iframe src="//x.breezy.hr/e"></iframe>'
    board = '<a href="https://jobs.lever.co/z">Board</a>'
    phrase = '<a href="/p">See our <b>open</b> things</a><a href="/q">View all</a><a href="/r">Browse jobs</a>'
    path = '<a href="/login?x=/jobs">no</a><a href="/careers/open">yes</a>'
    got = values(best, [path + phrase + board + frame, path + phrase + board, path + phrase, path, "<p>none</p>",
                        '<a href="/register/jobs">see jobs</a>'])
    assert got == ["https://x.breezy.hr/e", "https://jobs.lever.co/z", "https://h.com/r", "https://h.com/careers/open",
                   None, None]


def test_blocked_pages(values):
    got = values(H.is_blocked, ["<title>Just a Moment...</title>", "<p>CAPTCHA</p>", "<p>just a moment</p>"])
    assert got == [True, True, False]


def test_split_spans(values):
    got = values(lambda c: F.struct(T.split_spans(c)[0].alias("t"), T.split_spans(c)[1].alias("g")),
                 [["Featured", "Full-Time", "Go", "Contract"]], "array<string>")
    assert (got[0]["t"], got[0]["g"]) == ("contract", ["Go"])


def test_sorted_tokens(values):
    assert values(lambda c: sorted_tokens(c, F.lit("Acmé Co")), ["Data, Engineer (B)"]) == ["acm b co data engineer"]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    return row[-1]


def test_lcs_udf(spark):
    pairs = [("kitten", "sitting"), ("", "a"), ("abc", "abc"), ("a" * 70, "b" + "a" * 69), ("é ü", "ü é")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(lcs_length_udf()(F.col("a"), F.col("b"))).collect()]
    assert got == [_lcs(a, b) for a, b in pairs]


def test_allowed_indel_rounds_half_to_even(spark):
    df = spark.range(1, 400)
    for threshold in (84, 85, 90):
        rows = df.select("id", allowed_indel(F.col("id"), threshold).alias("k")).collect()
        for total, k in rows:
            def score(i, total=total):
                from fractions import Fraction
                return round(100 * (1 - Fraction(i, total)))
            assert k == max([i for i in range(total + 1) if score(i) >= threshold], default=-1), (total, threshold)


def test_anchor_markup(values):
    from joblattice.functions import html as H
    page = """<a data-href="/x" href="/y">one</a><!-- <a href="/c">no</a> --><a href=/bare>two</a>
<script>var s = '<a href="/s">no</a>';</script><a class='k' href='/q"r'>three</a><A HREF = "/up">4</A>
<a name=z>none</a><iframe data-src="/lazy"></iframe><iframe title="t" src='/frame'></iframe>"""
    got = values(lambda c: H.anchors(c), [page])[0]
    assert [(a["href"], a["text"]) for a in got] == [
        ("/y", "one"), ("/bare", "two"), ('/q"r', "three"), ("/up", "4")]
    assert values(lambda c: H.frames(c), [page])[0] == ["/frame"]
