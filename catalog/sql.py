"""The same views and helper expressions as DuckDB SQL."""

from __future__ import annotations

from joblattice.functions.html import AGGRESSIVE_TAGS, BLOCK_TAGS, ENTITIES, LIGHT_TAGS
from joblattice.functions.text import WHITESPACE

WS = "'" + WHITESPACE.replace("'", "''") + "'"
EPOCH0 = 1704067200
BREAKS = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lines(x: str) -> str:
    return f"string_split_regex({x}, {BREAKS})"


def clean_text(x: str) -> str:
    tidy = (f"array_to_string(list_transform({lines(x)}, lambda s: "
            f"regexp_replace(rtrim(s, {WS}), '[ \\t]{{2,}}', ' ', 'g')), chr(10))")
    return strip(f"regexp_replace({tidy}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def decode(x: str) -> str:
    for entity, char in ENTITIES:
        x = f"replace({x}, {quote(entity)}, {quote(char)})"
    return x


def text_without(x: str, tags) -> str:
    for pattern in [r"(?is)<head\b.*?</head>", r"(?s)<!--.*?-->",
                    *(rf"(?is)<{t}\b.*?</{t}\s*>" for t in tags)]:
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    x = f"regexp_replace({x}, '(?is)</?(?:{BLOCK_TAGS})\\b[^>]*>', chr(10), 'g')"
    return decode(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')")


def visible(x: str) -> str:
    return text_without(x, AGGRESSIVE_TAGS)


def light(x: str) -> str:
    return text_without(x, LIGHT_TAGS)


ANCHOR = r"""'(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>'"""


def inner(x: str) -> str:
    return strip(decode(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"))


def title_case(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


LISTINGS = f"""listings AS (
  SELECT doc_id AS id, doc_id AS seq, CAST(n_chars AS VARCHAR) AS external_id, source, title,
    lang || ' ' || source AS company, text AS description,
    'https://' || source || '.example.com/jobs/' || substr(md5(title), 1, 12) AS url,
    CASE lang WHEN 'en' THEN CASE WHEN n_chars < 2000 THEN 'Remote' ELSE 'Anywhere' END
      WHEN 'de' THEN 'Berlin' WHEN 'fr' THEN 'Remote (EU)'
      ELSE CASE WHEN n_chars >= 1500 THEN '' END END AS location,
    CASE WHEN n_chars >= 3000 THEN n_chars * 10 WHEN n_chars >= 1500 THEN 0 END AS salary_min,
    CASE WHEN n_chars >= 1000 THEN n_chars * 15 WHEN n_chars >= 500 THEN 0 END AS salary_max,
    [lang, source, ' ' || upper(lang) || ' ',
     CASE WHEN n_chars > 2000 THEN 'Long Form' ELSE 'brief' END] AS tags,
    CASE lang WHEN 'en' THEN 'Full_Time' WHEN 'de' THEN 'freelance' WHEN 'fr' THEN '' END AS job_type,
    {EPOCH0} + doc_id * 3600 AS scraped, n_chars >= 600 AS is_active,
    substr(sha256({strip("lower(title)")} || '|' || {strip("lower(lang || ' ' || source)")}), 1, 16)
      AS dedup_hash
  FROM (SELECT *, {strip("split_part(split_part(text, chr(10), 1), '.', 1)")} AS title
        FROM documents))"""
KNOWN = "known AS (SELECT * FROM listings WHERE id IN (SELECT doc_id FROM labels))"

_BLOCK = """CASE
    WHEN num < 250 THEN '<iframe src="//boards.greenhouse.io/embed/job_board?for=s' || num || '"></iframe>'
    WHEN num < 350 THEN '<a href="https://jobs.lever.co/site/' || num || '">Board</a>'
    WHEN num < 450 THEN '<a href="/team">View our <b>roles</b></a>'
    WHEN num < 550 THEN '<a href="careers/open?x=1">Work</a>'
    WHEN num < 800 THEN '<a href="/jobs/' || num || '">Data Engineer ' || num || '</a>'
    ELSE '' END"""
_NOISE = ('<a href="https://twitter.com/site">Follow us</a><a href="/privacy">Privacy policy</a>'
          '<a href="#top">Top of page</a>')
PAGES = f"""site AS (
  SELECT page_id AS seq, num, company, url AS careers_url, url AS final_url,
    CASE WHEN num < 40 THEN 404 WHEN num < 70 THEN 403 WHEN num < 90 THEN 401
      WHEN num < 130 THEN 503 WHEN num >= 160 THEN 200 END AS status,
    replace(CASE WHEN num >= 900 THEN regexp_replace(html, '(?s)<article>.*</article>', '', 'g')
                 ELSE html END, '</body>', {_BLOCK} || '{_NOISE}</body>') AS html
  FROM (SELECT *, CAST(regexp_extract(url, '/(\\d+)', 1) AS BIGINT) AS num,
               regexp_extract(url, '^https?://([^/]+)', 1) AS company FROM pages))"""
_ERROR = """CASE WHEN num < 40 THEN 'http_404 page not found' WHEN num < 70 THEN 'http_403 forbidden'
    WHEN num < 90 THEN 'http_401 unauthorized' WHEN num < 130 THEN 'http_503 server error'
    WHEN num < 160 THEN 'net::ERR_NAME_NOT_RESOLVED at ' || careers_url
    WHEN num < 180 THEN 'net::ERR_CONNECTION_REFUSED' WHEN num < 200 THEN 'SSL handshake failed'
    WHEN num < 215 THEN 'net::ERR_TOO_MANY_REDIRECTS' WHEN num < 235 THEN 'total timeout exceeded'
    WHEN num < 250 THEN 'Timeout 25000ms exceeded' WHEN num < 265 THEN 'net::ERR_ABORTED'
    WHEN num < 290 THEN 'insufficient_content' WHEN num < 300 THEN 'strange failure' END"""
ERROR_LOG = f"""{PAGES}, errlog AS (
  SELECT seq, num, company, careers_url, error,
    CASE WHEN error IS NULL AND num < 980 THEN 'page text' END AS text
  FROM (SELECT *, {_ERROR} AS error FROM site))"""
RECRAWL = f"""{ERROR_LOG}, recrawl AS (
  SELECT seq, num, company, careers_url, CASE WHEN num < 150 THEN NULL
      WHEN num > 950 THEN 'late failure' ELSE error END AS error,
    CASE WHEN num < 150 THEN 'fresh text' WHEN num > 950 THEN NULL
      WHEN error IS NULL THEN 'fresh text' END AS text FROM errlog)"""


def resolve(href: str, base: str) -> str:
    """Links of the test pages: absolute, protocol-relative, rooted, in-page or simple relative."""
    root = f"regexp_extract({base}, '^[a-z]+://[^/?#]*')"
    bare = f"regexp_extract({base}, '^[^?#]*')"
    folder = f"regexp_replace({bare}, '[^/]*$', '')"
    no_fragment = f"regexp_extract({base}, '^[^#]*')"
    return (f"CASE WHEN starts_with({href}, '//') THEN 'https:' || {href} "
            f"WHEN starts_with({href}, 'http') THEN {href} "
            f"WHEN {href} = '' THEN {base} "
            f"WHEN starts_with({href}, '#') THEN {no_fragment} || {href} "
            f"WHEN starts_with({href}, '?') THEN {bare} || {href} "
            f"WHEN starts_with({href}, '/') THEN {root} || {href} ELSE {folder} || {href} END")


# One row per anchor, in page order.
ANCHORS = f"""{PAGES}, anchors AS (
  SELECT seq, company, final_url, pos, {strip(decode("h"))} AS href, {inner("t")} AS text
  FROM (SELECT seq, company, final_url, unnest(regexp_extract_all(html, {ANCHOR}, 1)) AS h,
          unnest(regexp_extract_all(html, {ANCHOR}, 2)) AS t,
          unnest(range(1, 1 + len(regexp_extract_all(html, {ANCHOR})))) AS pos FROM site))"""
# Absolute page links: first per href, text cut to 200 characters.
LINKS = f"""{ANCHORS}, links AS (
  SELECT seq, pos, href, text FROM (
    SELECT seq, pos, {resolve("href", "final_url")} AS href, substr(text, 1, 200) AS text
    FROM anchors WHERE href <> '' AND href <> '#' AND NOT starts_with(href, 'javascript'))
  QUALIFY row_number() OVER (PARTITION BY seq, href ORDER BY pos) = 1)"""
COMPANIES = """companies AS (
  SELECT c_name AS name,
    CASE WHEN c_acctbal > 0 THEN 'https://c' || c_custkey || '.example.com' END AS website,
    CAST(NULL AS VARCHAR) AS careers_url, CAST(NULL AS VARCHAR) AS description,
    CASE WHEN c_acctbal > 5000 THEN '51-200' END AS size,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'fully-remote' WHEN 'MACHINERY' THEN 'remote-first'
      WHEN 'FURNITURE' THEN 'hybrid' END AS remote_policy,
    [lower(c_mktsegment), 'N' || c_nationkey] AS tech_stack, 'customers' AS source FROM customer)"""
COMPANY_BATCH = """company_batch AS (
  SELECT o_orderkey AS seq, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name,
    CASE WHEN o_orderstatus = 'P' THEN 'https://o' || o_orderkey END AS website,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'https://jobs/' || o_orderkey END AS careers_url,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS description,
    CASE WHEN o_totalprice > 400000 THEN '1000+' END AS size,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'hybrid' END AS remote_policy,
    CASE WHEN o_orderstatus = 'O' THEN [lower(o_orderpriority)] ELSE CAST([] AS VARCHAR[]) END
      AS tech_stack,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'orders-' || o_orderstatus END AS source
  FROM orders)"""
RUNS = """runs AS (
  SELECT event_id AS id, event_type AS source, ts AS started_at,
    CAST(floor(value) AS BIGINT) AS jobs_found,
    CAST(floor(floor(value) / 2) AS BIGINT) AS jobs_new,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status FROM events)"""
