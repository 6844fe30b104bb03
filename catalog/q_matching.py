"""Vocabulary hits, scores, matching jobs and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblattice.functions import scoring as SC
from joblattice.operators import matching as M
from joblattice.operators import ranking as R
from joblattice.plans import jobs as J
from joblattice.sinks import reports as RP

from . import sql as S
from . import views as V
from .registry import query

P = V.PROFILE
CATS = {name: (getattr(P, terms), mode) for name, terms, mode in SC.CATEGORIES}


def _word(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"


def _test(mode: str, text: str, term: str) -> str:
    low = term.lower()
    if mode == "any_word_gt3":
        words = [w for w in low.split() if len(w) > 3]
        return " OR ".join(f"contains({text}, '{w}')" for w in words) or "false"
    if mode == "whole_word":
        return _word(text, low)
    return f"contains({text}, '{low}')"


def hits(name: str, text: str) -> str:
    terms, mode = CATS[name]
    cases = ", ".join(f"CASE WHEN {_test(mode, text, t)} THEN {S.quote(t)} END" for t in terms)
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


def scored(src: str, role_text: str, text: str) -> str:
    """Subquery of ``src`` with hit lists and total."""
    cols = ", ".join(f"{hits(n, role_text if n == 'role' else text)} AS {n}_hits" for n in CATS)
    total = " + ".join(f"len({n}_hits) * {SC.WEIGHTS[n]}" for n in CATS)
    return f"(SELECT *, {total} AS total FROM (SELECT *, {cols} FROM {src}))"


EXCLUDED = ", ".join(S.quote(c.lower()) for c in P.exclude_companies)
TAGS = "'[\"' || array_to_string(tags, '\", \"') || '\"]'"
ROWS = f"""rows_ AS (SELECT *, lower(title) AS tl,
  lower(title || ' ' || coalesce(description, '') || ' ' || {TAGS}) AS tx FROM listings
  WHERE is_active)"""
LW = f"WITH {S.LISTINGS}, {ROWS} "
SCORED = scored("rows_", "tl", "tx")
MATCHED = (f"(SELECT * FROM {SCORED} WHERE total > 0 AND lower(trim(company)) NOT IN ({EXCLUDED}))")


def _joined(expr: str, empty: str = "") -> str:
    return f"CASE WHEN len({expr}) > 0 THEN array_to_string({expr}, ', ') ELSE '{empty}' END"


def _flat(df, *names):
    return [F.array_join(n, ",").alias(n) for n in names]


HITS = [f"{n}_hits" for n in CATS]
HITS_SQL = ", ".join(f"array_to_string({h}, ',') AS {h}" for h in HITS)


def _lines(spark, d):
    """Active listings with lower-cased title and text."""
    rows = M.listing_rows(V.text_listings(spark, d).where("is_active"))
    return rows.select("seq", F.lower("title").alias("tl"), SC.combined_text(
        F.col("title"), F.col("description"), F.col("tags_text")).alias("tx"))


@query("c34_role_hits", LW + f"SELECT seq, array_to_string({hits('role', 'tl')}, ',') AS role_hits FROM rows_")
def _(spark, d):
    return _lines(spark, d).select("seq", F.array_join(SC.role_hits(F.col("tl"), P.roles), ",")
                                   .alias("role_hits"))


@query("c35_substring_hits", LW + f"SELECT seq, array_to_string({hits('keyword', 'tx')}, ',') AS keyword_hits,"
       f" array_to_string({hits('ops', 'tx')}, ',') AS ops_hits FROM rows_")
def _(spark, d):
    return _lines(spark, d).select(
        "seq", F.array_join(SC.substring_hits(F.col("tx"), P.preferred_keywords), ",").alias("keyword_hits"),
        F.array_join(SC.substring_hits(F.col("tx"), P.operations_finance), ",").alias("ops_hits"))


@query("c36_whole_word_hits", LW + f"SELECT seq, array_to_string({hits('tech', 'tx')}, ',') AS tech_hits FROM rows_")
def _(spark, d):
    return _lines(spark, d).select("seq", F.array_join(SC.word_hits(F.col("tx"), P.technical), ",")
                                   .alias("tech_hits"))


@query("c37_combined_text", LW + "SELECT seq, md5(tx) AS digest, length(tx) AS chars FROM rows_")
def _(spark, d):
    return _lines(spark, d).select("seq", F.md5("tx").alias("digest"),
                                   F.length("tx").cast("bigint").alias("chars"))


@query("c38_truncations", f"WITH {S.LISTINGS} SELECT id, substr(title, 1, 200) AS title, "
       "md5(substr(description, 1, 2000)) AS head, substr(title, 1, 80) AS cell FROM listings")
def _(spark, d):
    return V.text_listings(spark, d).select(
        "id", F.left("title", F.lit(M.PAGE_TITLE_CHARS)).alias("title"),
        F.md5(F.left("description", F.lit(M.PAGE_TEXT_CHARS))).alias("head"),
        F.left("title", F.lit(RP.REPORT_TITLE_CHARS)).alias("cell"))


@query("c39_json_list", f"WITH {S.LISTINGS} SELECT id, {TAGS} AS tags_text FROM listings")
def _(spark, d):
    return V.text_listings(spark, d).select("id", SC.json_list(F.col("tags")).alias("tags_text"))


@query("a11_listing_score", LW + f"SELECT seq, {HITS_SQL}, CAST(total AS BIGINT) AS total FROM {SCORED}")
def _(spark, d):
    rows = M.listing_rows(V.text_listings(spark, d).where("is_active"))
    out = M.score_listings(rows, P)
    return out.select("seq", *_flat(out, *HITS), "total")


@query("j7_vocabulary_hits", LW + "SELECT seq, category, term, CAST(pos AS BIGINT) AS pos, "
       "CAST(weight AS BIGINT) AS weight FROM (" + " UNION ALL ".join(
           f"SELECT seq, '{n}' AS category, {S.quote(t)} AS term, {i} AS pos, {SC.WEIGHTS[n]} AS weight "
           f"FROM rows_ WHERE {_test(mode, 'tl' if n == 'role' else 'tx', t)}"
           for n, (terms, mode) in CATS.items() for i, t in enumerate(terms)) + ")")
def _(spark, d):
    return SC.vocabulary_hits(_lines(spark, d), "seq", F.col("tl"), F.col("tx"), [P]).drop("profile_id")


@query("f13_excluded_companies", f"WITH {S.LISTINGS} SELECT id, company FROM listings "
       f"WHERE lower(trim(company)) NOT IN ({EXCLUDED})")
def _(spark, d):
    return V.text_listings(spark, d).where(M.not_excluded(P)).select("id", "company")


@query("f14_positive_scores", LW + f"SELECT seq, CAST(total AS BIGINT) AS total FROM {SCORED} WHERE total > 0")
def _(spark, d):
    rows = M.listing_rows(V.text_listings(spark, d).where("is_active"))
    return M.score_listings(rows, P).where(M.positive()).select("seq", "total")


@query("w2_rank_all", LW + f"SELECT seq, CAST(total AS BIGINT) AS total, "
       f"row_number() OVER (ORDER BY total DESC, seq) AS rank FROM {MATCHED}")
def _(spark, d):
    matches = M.match_listings(V.text_listings(spark, d), P).select("seq", "total")
    return R.rank_all(matches, "total", "seq").select("seq", "total", "rank")


@query("o4_top_scores", LW + f"SELECT seq, CAST(total AS BIGINT) AS total FROM {MATCHED} "
       "ORDER BY total DESC, seq LIMIT 30")
def _(spark, d):
    matches = M.match_listings(V.text_listings(spark, d), P).select("seq", "total")
    return R.top_k(matches, 30, F.col("total").desc(), F.col("seq").asc())


@query("o6_list_prefix", LW + f"SELECT seq, array_to_string(keyword_hits[1:2], ',') AS keywords "
       f"FROM {SCORED}")
def _(spark, d):
    rows = M.listing_rows(V.text_listings(spark, d).where("is_active"))
    return M.score_listings(rows, P).select(
        "seq", F.array_join(RP.list_prefix(F.col("keyword_hits"), 2), ",").alias("keywords"))


def _salary(sep: str) -> str:
    from .q_listings import _salary as salary
    return salary(sep)


def _report(src: str, empty: str, sep: str, order: str = "seq") -> str:
    skills = "list_concat(list_concat(ops_hits, tech_hits), method_hits)"
    return f"""SELECT row_number() OVER (ORDER BY total DESC, {order}) AS rank, CAST(total AS BIGINT) AS score,
  company, title, coalesce(location, '') AS location, {_salary(sep)} AS salary, source,
  {_joined('role_hits', empty)} AS role_matches, {_joined('keyword_hits', empty)} AS keyword_matches,
  {_joined(skills, empty)} AS skills_matched, url AS apply_link FROM {src}"""


@query("k7_listing_report", LW + _report(MATCHED, "—", " – "))
def _(spark, d):
    return RP.listing_match_report(M.match_listings(V.text_listings(spark, d), P), "—", " – ")


@query("p7_listing_matching", LW + _report(MATCHED, "—", " – "))
def _(spark, d):
    return J.listing_matching(V.text_listings(spark, d), P)


@query("k10_listing_summary", LW + "SELECT row_number() OVER (ORDER BY total DESC, seq) AS rank, "
       "CAST(total AS BIGINT) AS score, substr(company, 1, 29) AS company, substr(title, 1, 39) AS title, "
       f"source FROM {MATCHED} ORDER BY rank LIMIT 10")
def _(spark, d):
    return RP.listing_summary(M.match_listings(V.text_listings(spark, d), P))


# --- crawled pages and the unified match -------------------------------------------------

_JOB_WORDS = ("analyst|specialist|engineer|manager|lead|director|coordinator|associate|officer|"
              "developer|architect|{}accountant|operation|finance|data|reconcil|settle|trade|report|"
              "automat|python|support")
_SKIP = " AND ".join(f"NOT contains({{0}}, '{w}')" for w in
                     ("login", "sign in", "privacy", "cookie", "terms of"))
_NOISE = (r"(?i)(mailto:|javascript:|tel:|(?:twitter|x|facebook|instagram|youtube|linkedin|bsky|tiktok|"
          r"threads|pinterest|reddit|medium)\.com|bsky\.app|t\.me|discord\.(?:gg|com)|/(?:cookie|privacy|"
          r"terms|legal|accessibility|gdpr|imprint|login|signin|sign-in|sign_in|logout|subscribe|"
          r"newsletter))")
# Noise-free links of the crawl log, first per href.
CLEAN_LINKS = f"""clean_links AS (SELECT l.seq, l.pos, l.href, l.text FROM links l
  WHERE l.href <> '' AND length(l.text) >= 3 AND NOT starts_with(l.href, '#')
    AND NOT regexp_matches(l.href, '{_NOISE}'))"""
CRAWL = f"""{S.LINKS}, {CLEAN_LINKS}, crawl AS (
  SELECT seq, num, company, careers_url, final_url, error,
    CASE WHEN error IS NULL AND num < 980 THEN {S.clean_text(S.visible('html'))} END AS text,
    error IS NULL AND num < 950 AS has_links FROM (SELECT *, {S._ERROR} AS error FROM site)),
  good AS (SELECT * FROM crawl WHERE error IS NULL AND coalesce(text, '') <> '')"""
F18 = ("length(text) >= 5 AND href <> '' AND " + _SKIP.format("lower(text || href)")
       + f" AND regexp_matches(text, '(?i)({_JOB_WORDS.format('')})')")
PAGE_ROWS = f"""page_links AS (SELECT g.seq, g.company, c.href, c.text AS link_text, g.text AS body,
    row_number() OVER (PARTITION BY g.seq ORDER BY c.pos) - 1 AS lpos
  FROM good g JOIN clean_links c ON g.seq = c.seq AND g.has_links
  WHERE {F18.replace('href', 'c.href').replace('(text', '(c.text').replace('lower(text', 'lower(c.text')}),
 page_rows AS (
  SELECT seq, lpos AS pos, substr(trim(link_text), 1, 200) AS title, company, href AS url,
    substr(body, 1, 2000) AS description FROM page_links
  UNION ALL SELECT seq, 0, 'Careers at ' || company, company,
    coalesce(nullif(final_url, ''), careers_url), substr(text, 1, 2000) FROM good g
  WHERE NOT has_links OR NOT EXISTS (SELECT 1 FROM clean_links c WHERE c.seq = g.seq))"""


@query("u4_career_page_rows", f"WITH {CRAWL}, {PAGE_ROWS} SELECT seq, CAST(pos AS BIGINT) AS pos, title, company, url, "
       "md5(description) AS digest FROM page_rows")
def _(spark, d):
    return M.career_page_rows(V.crawl_log(spark, d)).select(
        "seq", F.col("pos").cast("bigint").alias("pos"), "title", "company", "url",
        F.md5("description").alias("digest"))


@query("f18_listing_links", f"WITH {CRAWL} SELECT c.seq, c.href, c.text FROM clean_links c JOIN good g "
       f"ON c.seq = g.seq AND g.has_links WHERE {F18.replace('href', 'c.href').replace('(text', '(c.text')}")
def _(spark, d):
    from joblattice.functions.crawl import is_listing_link, is_success
    rows = V.crawl_log(spark, d).where(is_success(F.col("error"), F.col("text")))
    found = F.filter("links", lambda x: is_listing_link(x["text"], x["href"]))
    return rows.select("seq", F.explode(found).alias("x")).select("seq", "x.href", "x.text")


ALL_ROWS = f"""{S.LISTINGS}, {CRAWL}, {PAGE_ROWS}, all_rows AS (
  SELECT 0 AS side, seq, 0 AS pos, title, company, url, source, location, salary_min, salary_max,
    lower(title) AS tl, lower(title || ' ' || coalesce(description, '') || ' ' || {TAGS}) AS tx
  FROM listings WHERE is_active
  UNION ALL SELECT 1, seq, pos, title, company, url, 'career_page', NULL, NULL, NULL, lower(title),
    lower(title || ' ' || coalesce(description, '') || ' ' || '') FROM page_rows),
 first_urls AS (SELECT * FROM all_rows WHERE lower(trim(company)) NOT IN ({EXCLUDED})
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY side, seq, pos) = 1)"""
UNIFIED = f"(SELECT * FROM {scored('first_urls', 'tl', 'tx')} WHERE total > 0)"


@query("u1_union_rows", f"WITH {ALL_ROWS} SELECT source, count(*) AS n, count(DISTINCT url) AS urls "
       "FROM all_rows GROUP BY source")
def _(spark, d):
    rows = M.listing_rows(V.text_listings(spark, d).where("is_active")).unionByName(
        M.career_page_rows(V.crawl_log(spark, d)))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


@query("w7_first_seen_urls", f"WITH {ALL_ROWS} SELECT seq, CAST(pos AS BIGINT) AS pos, url, source FROM first_urls")
def _(spark, d):
    rows = (M.listing_rows(V.text_listings(spark, d).where("is_active")).withColumn("side", F.lit(0))
            .unionByName(M.career_page_rows(V.crawl_log(spark, d)).withColumn("side", F.lit(1))))
    kept = rows.where(M.not_excluded(P)).select("side", "seq", "pos", "url", "source")
    return M.first_seen_urls(kept).select("seq", F.col("pos").cast("bigint").alias("pos"), "url", "source")


@query("p8_unified_matching", f"WITH {ALL_ROWS} " + _report(UNIFIED, "", " - ", "side, seq, pos"))
def _(spark, d):
    return J.unified_matching(V.text_listings(spark, d), V.crawl_log(spark, d), P)


@query("k10_unified_summary", f"WITH {ALL_ROWS} SELECT row_number() OVER (ORDER BY total DESC, side, seq, pos) AS rank, "
       "CAST(total AS BIGINT) AS score, substr(company, 1, 24) AS company, substr(title, 1, 50) AS title, "
       f"substr(source, 1, 13) AS source FROM {UNIFIED} ORDER BY rank LIMIT 15")
def _(spark, d):
    return RP.unified_summary(M.match_all(V.text_listings(spark, d), V.crawl_log(spark, d), P))


PAGES_SCORED = scored(f"(SELECT *, lower(text) AS tx FROM good WHERE lower(company) NOT IN ({EXCLUDED}))",
                      "tx", "tx")
_ATS_POSTING = (r"(?i)(greenhouse\.io/.+/jobs/|lever\.co/.+/|ashbyhq\.com/.+/|myworkdayjobs\.com/.+/job/|"
                r"workable\.com/.+/j/|bamboohr\.com/careers/|/jobs?/\d|/positions?/\d|/careers/.+/\d)")
_BOTH = "lower(c.text || ' ' || c.href)"
F17 = ("length(c.text) >= 3 AND " + _SKIP.format(_BOTH)
       + f" AND (regexp_matches(c.text, '(?i)({_JOB_WORDS.format('admin|')})') OR "
       f"regexp_matches(c.href, '{_ATS_POSTING}')) AND "
       + " AND ".join(f"NOT contains({_BOTH}, '{k.lower()}')" for k in P.exclude_keywords))
PAGE_MATCH = f"""WITH {CRAWL}, hit AS (SELECT * FROM {PAGES_SCORED} WHERE total > 0),
 rel AS (SELECT h.seq, c.pos, c.text AS title, c.href AS url FROM hit h JOIN clean_links c
         ON c.seq = h.seq AND h.has_links WHERE {F17})"""


@query("f17_relevant_page_links", PAGE_MATCH + " SELECT seq, title, url FROM rel")
def _(spark, d):
    m = M.match_pages(V.crawl_log(spark, d), P)
    return m.select("seq", F.explode("job_links").alias("x")).select("seq", "x.title", "x.url")


@query("a10_page_score", PAGE_MATCH + f" SELECT seq, {HITS_SQL}, CAST(total AS BIGINT) AS total FROM {PAGES_SCORED}")
def _(spark, d):
    rows = V.crawl_log(spark, d).where("error is null and text is not null and text <> ''")
    out = M.score_pages(rows.where(M.not_excluded(P, trim=False)).select("seq", "text"), P)
    return out.select("seq", *_flat(out, *HITS), "total")


_PAGE_REPORT = f"""{PAGE_MATCH} SELECT row_number() OVER (ORDER BY total DESC, h.seq) AS rank,
  CAST(total AS BIGINT) AS score, company, {_joined('role_hits')} AS role_title_hits,
  {_joined('keyword_hits')} AS preferred_keywords, {_joined('ops_hits')} AS ops_finance_hits,
  {_joined('tech_hits')} AS tech_hits, {_joined('method_hits')} AS methodology_hits,
  {_joined('exclude_hits')} AS excluded_keywords, careers_url, final_url,
  coalesce(l.lines, '') AS top_job_links FROM hit h LEFT JOIN (
    SELECT seq, string_agg(substr(title, 1, 80) || ' — ' || url, chr(10) ORDER BY pos) AS lines
    FROM (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY seq ORDER BY pos) <= 8)
    GROUP BY seq) l ON h.seq = l.seq"""


@query("k6_page_report", _PAGE_REPORT)
def _(spark, d):
    return RP.page_match_report(M.match_pages(V.crawl_log(spark, d), P))


@query("p6_page_matching", _PAGE_REPORT)
def _(spark, d):
    return J.page_matching(V.crawl_log(spark, d), P)


@query("k10_page_summary", PAGE_MATCH + """ SELECT row_number() OVER (ORDER BY total DESC, h.seq) AS rank,
  CAST(total AS BIGINT) AS score, substr(company, 1, 34) AS company,
  CASE WHEN len(role_hits) > 0 THEN array_to_string(role_hits[1:3], ', ') ELSE '-' END AS roles,
  array_to_string(keyword_hits[1:4], ', ') AS keywords, coalesce(l.lines, '') AS links, final_url
  FROM hit h LEFT JOIN (SELECT seq, string_agg(substr(title, 1, 60), ' | ' ORDER BY pos) AS lines
    FROM (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY seq ORDER BY pos) <= 5)
    GROUP BY seq) l ON h.seq = l.seq ORDER BY rank LIMIT 30""")
def _(spark, d):
    return RP.page_summary(M.match_pages(V.crawl_log(spark, d), P))


@query("k5_write_page_matches", PAGE_MATCH + " SELECT careers_url, company, CAST(total AS BIGINT) AS total, "
       "(SELECT count(*) FROM rel r WHERE r.seq = h.seq) AS n_links FROM hit h")
def _(spark, d):
    from joblattice.session import new_folder
    from joblattice.sinks.files import write_page_matches
    path = new_folder(spark, "page-matches")
    write_page_matches(M.match_pages(V.crawl_log(spark, d), P), path)
    schema = ("careers_url string, company string, job_links array<struct<title:string,url:string>>, "
              "scores struct<total:bigint>")
    return spark.read.schema(schema).json(path).select(
        "careers_url", "company", F.col("scores.total").alias("total"),
        F.size("job_links").cast("bigint").alias("n_links"))
