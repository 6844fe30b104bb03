"""Crawl log diagnostics, re-crawl, HTML extraction and page acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblattice.functions import crawl as CR
from joblattice.functions import html as H
from joblattice.functions import urls as U
from joblattice.functions.text import clean_text
from joblattice.operators import crawl_log as O
from joblattice.operators import ranking as R
from joblattice.plans import jobs as J
from joblattice.sinks import reports as RP

from . import sql as S
from . import views as V
from .q_matching import _NOISE, CRAWL
from .registry import query


def categorize(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, {S.quote(p.replace('(?iU)', '(?i)'))}) THEN '{n}'"
                     for n, p in CR.ERROR_CATEGORIES)
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'ok' {cases} ELSE 'other' END"


OK = "(coalesce(error, '') = '' AND coalesce(text, '') <> '')"
E = f"WITH {S.ERROR_LOG} "
FAILED = f"(SELECT *, {categorize('error')} AS category FROM errlog WHERE coalesce(error, '') <> '')"
DOMAIN = "lower(regexp_extract(careers_url, '^[a-z]+://([^/?#]*)', 1))"
PCT = f"round(count(*) FILTER (WHERE {OK}) * 100.0 / count(*), 1)"


@query("s1_read_crawl_log", E + "SELECT seq, company, careers_url, error, text FROM errlog")
def _(spark, d):
    from joblattice.sources.crawl_log import parse_crawl_text
    log = V.error_log(spark, d)
    fields = F.struct("company", "careers_url", "error", "text")
    packed = log.select("seq", F.to_json(F.array(fields)).alias("payload"))
    return parse_crawl_text(packed, "payload", ("seq",)).select(
        "seq", "company", "careers_url", "error", "text")


@query("s2_read_successes", E + f"SELECT company, careers_url, text FROM errlog WHERE {OK}")
def _(spark, d):
    from joblattice.session import new_folder
    from joblattice.sources.crawl_log import read_successes
    path = new_folder(spark, "crawl-lines")
    V.error_log(spark, d).write.json(path)
    return read_successes(spark, path + "-absent.json", path).select("company", "careers_url", "text")


@query("s3_read_tolerant", E + "SELECT company, careers_url, error FROM errlog WHERE num < 900")
def _(spark, d):
    # Records of high-numbered pages are written damaged: cut off before the closing brace.
    from joblattice.session import new_folder
    from joblattice.sources.crawl_log import read_tolerant
    path = new_folder(spark, "crawl-damaged")
    line = F.to_json(F.struct("company", "careers_url", "error"))
    damaged = F.substr(line, F.lit(1), F.length(line) - 1)
    V.error_log(spark, d).select(F.when(F.col("num") < 900, line).otherwise(damaged)).write.text(path)
    return read_tolerant(spark, path, multi_line=False).select("company", "careers_url", "error")


@query("k4_write_crawl_log", E + "SELECT company, seq, error FROM errlog")
def _(spark, d):
    from joblattice.session import new_folder
    from joblattice.sinks.files import write_crawl_log
    path = new_folder(spark, "crawl-sorted")
    write_crawl_log(V.error_log(spark, d), path)
    return spark.read.schema("company string, seq bigint, error string").json(path)


@query("f10_crawl_success", E + f"SELECT seq, company FROM errlog WHERE {OK}")
def _(spark, d):
    return O.successes(V.error_log(spark, d)).select("seq", "company")


@query("f11_crawl_failure", E + "SELECT seq, error FROM errlog WHERE coalesce(error, '') <> ''")
def _(spark, d):
    return O.failures(V.error_log(spark, d)).select("seq", "error")


@query("f12_recrawl_targets", E + f"SELECT company, careers_url FROM {FAILED} "
       "WHERE category IN ('http_404', 'dns_error', 'timeout_total')")
def _(spark, d):
    return O.recrawl_targets(V.error_log(spark, d), ("http_404", "dns_error", "timeout_total"))


@query("c31_categorize", E + f"SELECT seq, {categorize('error')} AS category FROM errlog")
def _(spark, d):
    return V.error_log(spark, d).select("seq", CR.categorize(F.col("error")).alias("category"))


@query("c27_url_domain", E + f"SELECT seq, {DOMAIN} AS domain FROM errlog")
def _(spark, d):
    return V.error_log(spark, d).select("seq", U.url_authority(F.col("careers_url")).alias("domain"))


@query("c28_url_path", f"WITH {S.ANCHORS} SELECT seq, pos, coalesce(nullif(regexp_extract({S.resolve('href', 'final_url')}, "
       "'^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM anchors")
def _(spark, d):
    rows = _anchor_rows(spark, d)
    return rows.select("seq", "pos", U.href_path(F.col("href"), F.col("final_url")).alias("path"))


@query("c29_status_label", f"WITH {S.PAGES} SELECT seq, CASE status WHEN 404 THEN 'http_404 page not found' "
       "WHEN 403 THEN 'http_403 forbidden' WHEN 401 THEN 'http_401 unauthorized' "
       "WHEN 503 THEN 'http_503 server error' END AS label FROM site")
def _(spark, d):
    return V.pages(spark, d).select("seq", CR.status_error_label(F.col("status")).alias("label"))


@query("c30_error_message", "SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 300) AS message FROM documents")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", CR.error_message(F.col("text")).alias("message"))


@query("a4_failures_by_category", E + f"SELECT category, count(*) AS cnt FROM {FAILED} GROUP BY category")
def _(spark, d):
    return O.failures_by_category(V.error_log(spark, d))


@query("a5_failures_by_domain", E + f"SELECT {DOMAIN} AS domain, count(*) AS cnt FROM {FAILED} "
       "GROUP BY domain ORDER BY cnt DESC, domain LIMIT 25")
def _(spark, d):
    return O.failures_by_domain(V.error_log(spark, d))


_SUMMARY = (f"count(*) AS total, count(*) FILTER (WHERE {OK}) AS success, "
            f"count(*) FILTER (WHERE coalesce(error, '') <> '') AS failure, {PCT} AS success_pct")


@query("a6_success_summary", E + f"SELECT {_SUMMARY} FROM errlog")
def _(spark, d):
    return O.success_summary(V.error_log(spark, d))


@query("a8_error_totals", E + "SELECT count(*) AS records, count(*) FILTER (WHERE coalesce(error, '') <> '') "
       "AS errors FROM errlog")
def _(spark, d):
    return O.error_totals(O.progress_metrics(V.error_log(spark, d)))


@query("a13_progress", E + """SELECT step, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS completed,
 CAST(sum(e) OVER (ORDER BY step) AS BIGINT) AS errors,
 CAST(floor(sum(n) OVER (ORDER BY step) * 100 / sum(n) OVER ()) AS BIGINT) AS pct FROM (
 SELECT CAST(floor(seq * 20 / (SELECT max(seq) + 1 FROM errlog)) AS BIGINT) AS step, count(*) AS n,
   count(*) FILTER (WHERE coalesce(error, '') <> '') AS e FROM errlog GROUP BY 1)""")
def _(spark, d):
    return O.progress_steps(V.error_log(spark, d), "seq")


_CYCLES = """cycles AS (SELECT *, CAST(floor(num / 200) AS BIGINT) AS cycle FROM errlog)"""


@query("a14_success_by_cycle", f"WITH {S.ERROR_LOG}, {_CYCLES} SELECT cycle, total, success, success_pct, "
       f"success - lag(success) OVER (ORDER BY cycle) AS gain FROM (SELECT cycle, {_SUMMARY} FROM cycles GROUP BY cycle)")
def _(spark, d):
    log = V.error_log(spark, d).withColumn("cycle", F.floor(F.col("num") / 200))
    return O.success_by_cycle(log)


_SAMPLES = (f"SELECT * FROM (SELECT category, company, careers_url, error, seq, "
            "row_number() OVER (PARTITION BY category ORDER BY seq) AS pos, "
            f"count(*) OVER (PARTITION BY category) AS category_size FROM {FAILED}) WHERE pos <= 8")


@query("w3_failure_samples", E + _SAMPLES)
def _(spark, d):
    return O.failure_samples(V.error_log(spark, d), "seq")


_K8 = f"""WITH {S.ERROR_LOG}, f AS (SELECT * FROM {FAILED}), s AS (SELECT {_SUMMARY} FROM errlog)
SELECT 'summary' AS section, 'total' AS key, '' AS detail, CAST(total AS DOUBLE) AS value FROM s
UNION ALL SELECT 'summary', 'success', '', success FROM s
UNION ALL SELECT 'summary', 'success_pct', '', success_pct FROM s
UNION ALL SELECT 'summary', 'failure', '', failure FROM s
UNION ALL SELECT 'category', category, '', count(*) FROM f GROUP BY category
UNION ALL SELECT 'domain', k, '', n FROM (SELECT {DOMAIN} AS k, count(*) AS n FROM f GROUP BY k ORDER BY n DESC, k LIMIT 25)
UNION ALL SELECT 'sample', category, company || ' -> ' || careers_url || ' ' || error, pos FROM ({_SAMPLES})"""


@query("k8_failure_report", _K8)
def _(spark, d):
    return RP.failure_report(V.error_log(spark, d), "seq")


@query("p4_crawl_diagnostics", _K8)
def _(spark, d):
    return J.diagnose(V.error_log(spark, d))


_LAST = "QUALIFY row_number() OVER (PARTITION BY company ORDER BY side DESC, seq DESC) = 1"
MERGED = (f"(SELECT company, seq, error, text, side FROM (SELECT *, 0 AS side FROM errlog UNION ALL SELECT *, 1 FROM recrawl) {_LAST})")
RC = f"WITH {S.RECRAWL} "


@query("w6_last_per_company", E + "SELECT company, seq, error FROM errlog "
       "QUALIFY row_number() OVER (PARTITION BY company ORDER BY seq DESC) = 1")
def _(spark, d):
    return R.keep_last(V.error_log(spark, d), ["company"], "seq").select("company", "seq", "error")


@query("j8_merge_recrawl", RC + f"SELECT company, seq, error, text FROM {MERGED}")
def _(spark, d):
    merged = O.merge_recrawl(V.error_log(spark, d), V.recrawl(spark, d))
    return merged.select("company", "seq", "error", "text")


# Whole crawl records: text and links as they are crawled, merged and written.
_RECORDS = f"""WITH {CRAWL}, linked AS (SELECT seq, string_agg(text || '|' || href, chr(10) ORDER BY pos) AS links
  FROM clean_links GROUP BY seq),
 records AS (SELECT c.seq, num, company, careers_url, final_url, error, text,
    CASE WHEN has_links THEN coalesce(l.links, '') ELSE '' END AS links FROM crawl c LEFT JOIN linked l ON c.seq = l.seq),
 again AS (SELECT seq, num, company, careers_url, final_url, error, CASE WHEN error IS NULL THEN 'fresh ' || coalesce(text, '') END AS text,
    CASE WHEN num < 150 THEN 'Open roles|' || careers_url ELSE links END AS links
  FROM (SELECT * REPLACE (CASE WHEN num < 150 THEN NULL WHEN num > 950 THEN 'late failure' ELSE error END AS error) FROM records)) """


@query("j8_merge_records", _RECORDS + f"""SELECT company, seq, error, md5(text) AS text_md5, md5(links) AS links_md5
 FROM (SELECT *, 0 AS side FROM records UNION ALL SELECT *, 1 FROM again) {_LAST}""")
def _(spark, d):
    from joblattice.session import cut_lineage
    records = cut_lineage(V.crawl_log(spark, d))
    merged = O.merge_recrawl(records, V.recrawl_records(records))
    return merged.select("company", "seq", "error", F.md5("text").alias("text_md5"),
                         F.md5(V.link_lines(F.col("links"))).alias("links_md5"))


@query("k4_write_records", _RECORDS + """SELECT company, careers_url, final_url, error, md5(text) AS text_md5,
 md5(links) AS links_md5 FROM records""")
def _(spark, d):
    from joblattice.session import new_folder
    from joblattice.sinks.files import write_crawl_log
    from joblattice.sources.crawl_log import read_crawl_lines
    path = new_folder(spark, "crawl-records")
    write_crawl_log(V.crawl_log(spark, d), path)
    return read_crawl_lines(spark, path).select(
        "company", "careers_url", "final_url", "error", F.md5("text").alias("text_md5"),
        F.md5(V.link_lines(F.col("links"))).alias("links_md5"))


_RECOVERED = """SELECT count(*) FILTER (WHERE is_new AND NOT failed AND coalesce(prev, true)) AS recovered FROM (
 SELECT *, lag(failed) OVER (PARTITION BY company ORDER BY is_new, seq) AS prev FROM (
  SELECT company, seq, coalesce(error, '') <> '' AS failed, false AS is_new FROM errlog
  UNION ALL SELECT company, seq, coalesce(error, '') <> '', true FROM recrawl))"""


@query("j9_recovered", RC + _RECOVERED)
def _(spark, d):
    return O.recovered_count(V.error_log(spark, d), V.recrawl(spark, d))


@query("o5_company_order", E + "SELECT company, seq FROM errlog")
def _(spark, d):
    return O.by_company(V.error_log(spark, d)).select("company", "seq")


@query("p5_recrawl_merge", RC + f"""SELECT 'recovered' AS metric, recovered AS value FROM ({_RECOVERED})
UNION ALL SELECT 'targets', count(*) FROM errlog WHERE coalesce(error, '') <> ''
UNION ALL SELECT 'merged', count(*) FROM {MERGED}
UNION ALL SELECT 'success', count(*) FROM {MERGED} WHERE {OK}""")
def _(spark, d):
    out = J.reconcile(V.error_log(spark, d), V.recrawl(spark, d))

    def row(name, df, value):
        return df.select(F.lit(name).alias("metric"), value.alias("value"))
    n = F.count(F.lit(1)).alias("n")
    return (row("recovered", out.recovered, F.col("recovered"))
            .unionByName(row("targets", out.targets.agg(n), F.col("n")))
            .unionByName(row("merged", out.merged.agg(n), F.col("n")))
            .unionByName(row("success", out.summary, F.col("success"))))


# --- html --------------------------------------------------------------------------------

A = f"WITH {S.ANCHORS} "


def _anchor_rows(spark, d):
    """One row per anchor, in page order."""
    return V.pages(spark, d).select("seq", "final_url", F.posexplode(H.anchors(F.col("html"))).alias("p", "a")
                                    ).select("seq", "final_url", (F.col("p") + 1).cast("bigint").alias("pos"), "a.*")


@query("s19_visible_text", f"WITH {S.PAGES} SELECT seq, md5({S.visible('html')}) AS digest FROM site")
def _(spark, d):
    return V.pages(spark, d).select("seq", F.md5(H.visible_text(F.col("html"))).alias("digest"))


@query("s20_light_text", f"WITH {S.PAGES} SELECT seq, md5({S.light('html')}) AS digest FROM site")
def _(spark, d):
    return V.pages(spark, d).select("seq", F.md5(H.light_text(F.col("html"))).alias("digest"))


@query("c25_clean_text", f"SELECT doc_id, md5({S.clean_text('text')}) AS digest, page FROM (SELECT doc_id, text, 0 AS page "
       f"FROM documents UNION ALL SELECT page_id, {S.visible('html')}, 1 FROM pages)")
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text", F.lit(0).alias("page"))
    site = V.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"),
                                             H.visible_text(F.col("html")).alias("text"), F.lit(1).alias("page"))
    return docs.unionByName(site).select("doc_id", F.md5(clean_text(F.col("text"))).alias("digest"), "page")


@query("s21_page_links", f"WITH {S.LINKS} SELECT seq, href, text FROM links")
def _(spark, d):
    rows = V.pages(spark, d).select("seq", F.explode(H.page_links(H.anchors(F.col("html")), F.col("final_url"))).alias("x"))
    return rows.select("seq", "x.href", "x.text")


@query("s22_frames", f"WITH {S.PAGES} SELECT seq, src FROM (SELECT seq, unnest(regexp_extract_all(html, "
       "'(?is)<iframe\\b[^>]*?\\bsrc\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS src FROM site)")
def _(spark, d):
    return V.pages(spark, d).select("seq", F.explode(H.frames(F.col("html"))).alias("src"))


@query("s23_job_cards", A + "SELECT seq, href, substr(text, 1, 600) AS text FROM anchors "
       "WHERE contains(href, '/jobs/') AND href NOT IN ('/jobs', '/jobs/')")
def _(spark, d):
    rows = V.pages(spark, d).select("seq", F.explode(H.job_cards(H.anchors(F.col("html")))).alias("x"))
    return rows.select("seq", "x.href", "x.text")


@query("f15_blocked_pages", f"""WITH {S.PAGES} SELECT seq FROM site WHERE contains(lower(html), 'captcha')
 OR contains(lower(html), 'challenge') OR num < 60
 OR contains(regexp_extract(lower(html), '(?s)<title[^>]*>(.*?)</title>', 1), 'just a moment')""")
def _(spark, d):
    # Pages with low url numbers are turned into challenge pages first.
    p = V.pages(spark, d).withColumn("html", F.when(F.col("num") < 60, F.replace(
        "html", F.lit("<title>"), F.lit("<title>Just a Moment... "))).otherwise(F.col("html")))
    return p.where(H.is_blocked(F.col("html"))).select("seq")


@query("f16_link_noise", f"""WITH {S.LINKS} SELECT seq, href, text FROM links WHERE href <> '' AND length(text) >= 3
 AND NOT starts_with(href, '#') AND NOT regexp_matches(href, '{_NOISE}')""")
def _(spark, d):
    links = CR.drop_noise_links(H.page_links(H.anchors(F.col("html")), F.col("final_url")))
    return V.pages(spark, d).select("seq", F.explode(links).alias("x")).select("seq", "x.href", "x.text")


def _ats(x: str) -> str:
    return f"regexp_matches({x}, {S.quote(U.ATS_HOST)})"


_FULL = S.resolve("href", "final_url")


@query("f21_ats_host", f"WITH {S.ANCHORS} SELECT seq, pos FROM (SELECT seq, pos, {_FULL} AS url FROM anchors) WHERE {_ats('url')}")
def _(spark, d):
    full = U.resolve(F.col("href"), F.col("final_url"))
    return _anchor_rows(spark, d).select("seq", "pos", full.alias("url")).where(
        U.is_ats_host(F.col("url"))).select("seq", "pos")


_PATH_OF = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("f22_auth_path", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '/sign-in/' || o_orderkey "
       "WHEN 'O' THEN '/jobs/' || o_orderkey ELSE '/Account?u=' || o_orderkey END AS path FROM orders) "
       f"WHERE regexp_matches(path, {S.quote(U.AUTH_PATH)})")
def _(spark, d):
    key, st = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    path = (F.when(st == "F", F.concat(F.lit("/sign-in/"), key)).when(st == "O", F.concat(F.lit("/jobs/"), key))
            .otherwise(F.concat(F.lit("/Account?u="), key)))
    return V.table(spark, d, "orders").where(U.is_auth_path(path)).select("o_orderkey")


@query("c22_resolve", A + f"SELECT seq, pos, {_FULL} AS url FROM anchors")
def _(spark, d):
    return _anchor_rows(spark, d).select("seq", "pos", U.resolve(F.col("href"), F.col("final_url")).alias("url"))


_EMBED = U.EMBED_BOARD
_BOARD = (f"CASE WHEN regexp_extract({{0}}, '{_EMBED}', 1) <> '' THEN 'https://job-boards.greenhouse.io/' || "
          f"regexp_extract({{0}}, '{_EMBED}', 1) END")


@query("c23_canonical_board", f"WITH {S.PAGES} SELECT seq, {_BOARD.format('src')} AS board FROM (SELECT seq, unnest("
       "regexp_extract_all(html, '(?is)<iframe\\b[^>]*?\\bsrc\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS src FROM site)")
def _(spark, d):
    rows = V.pages(spark, d).select("seq", F.explode(H.frames(F.col("html"))).alias("src"))
    return rows.select("seq", U.canonical_board_url(F.col("src")).alias("board"))


_NOT_AUTH = f"NOT regexp_matches({_PATH_OF}, {S.quote(U.AUTH_PATH)})"
_BEST = f"""{S.ANCHORS}, full_ AS (SELECT seq, pos, text, {_FULL} AS url FROM anchors WHERE href <> ''
   AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript')),
 frame_ AS (SELECT seq, arg_min(src, i) AS src FROM (SELECT seq, unnest(s) AS src, unnest(range(1, 1 + len(s))) AS i
   FROM (SELECT seq, regexp_extract_all(html, '(?is)<iframe\\b[^>]*?\\bsrc\\s*=\\s*["'']([^"'']*)["'']', 1) AS s FROM site))
   WHERE {_ats('src')} GROUP BY seq),
 best AS (SELECT s.seq, s.company, s.final_url, coalesce(
   (SELECT CASE WHEN starts_with(src, '//') THEN 'https:' || src ELSE src END FROM frame_ f WHERE f.seq = s.seq),
   (SELECT arg_min(url, pos) FROM full_ f WHERE f.seq = s.seq AND {_ats('url')}),
   (SELECT arg_min(url, pos) FROM full_ f WHERE f.seq = s.seq AND {_NOT_AUTH}
      AND regexp_matches(text, {S.quote(U.JOBS_PHRASE.replace('(?iU)', '(?i)'))})),
   (SELECT arg_min(url, pos) FROM full_ f WHERE f.seq = s.seq AND {_NOT_AUTH}
      AND regexp_matches({_PATH_OF}, {S.quote(U.JOBS_PATH)}))) AS jobs_url FROM site s)"""


@query("c32_best_jobs_url", f"WITH {_BEST} SELECT seq, jobs_url FROM best")
def _(spark, d):
    return V.pages(spark, d).select("seq", CR.best_jobs_url(
        H.frames(F.col("html")), H.anchors(F.col("html")), F.col("final_url")).alias("jobs_url"))


@query("p11_next_pages", f"WITH {_BEST} SELECT seq, company, final_url, jobs_url, coalesce({_BOARD.format('jobs_url')}, "
       f"jobs_url, {_BOARD.format('final_url')}) AS next_url FROM best")
def _(spark, d):
    return J.next_pages(V.pages(spark, d))


_TEXTS = f"""{S.LINKS}, texts AS (SELECT *, {S.clean_text(S.visible('html'))} AS full_text,
   {S.clean_text(S.light('html'))} AS light_text, coalesce(status < 400, false) AS healthy FROM site),
 chosen AS (SELECT *, CASE WHEN length(full_text) < 200 AND length(light_text) >= CASE WHEN healthy THEN 100 ELSE 200 END
   THEN light_text ELSE full_text END AS body, CASE WHEN healthy AND {_ats('final_url')} THEN 50 WHEN healthy THEN 100
   ELSE 200 END AS need FROM texts)"""


@query("c33_light_fallback", f"WITH {_TEXTS} SELECT seq, md5(body) AS digest, length(body) AS chars FROM chosen")
def _(spark, d):
    h = F.col("html")
    texts = V.pages(spark, d).select("seq", "status", clean_text(H.visible_text(h)).alias("a"),
                                     clean_text(H.light_text(h)).alias("b"))
    body = CR.choose_text(F.col("a"), F.col("b"), F.col("status"))
    return texts.select("seq", F.md5(body).alias("digest"), F.length(body).cast("bigint").alias("chars"))


@query("f20_content_floor", f"WITH {_TEXTS} SELECT seq, CAST(need AS BIGINT) AS need, length(full_text) >= need AS accepted FROM chosen")
def _(spark, d):
    need = CR.min_chars(F.col("status"), F.col("final_url"))
    text = clean_text(H.visible_text(F.col("html")))
    return V.pages(spark, d).select("seq", need.cast("bigint").alias("need"),
                                    (F.length(text) >= need).alias("accepted"))


@query("p3_accept_pages", f"""WITH {_TEXTS} SELECT seq, company, final_url,
 CASE WHEN length(body) < need THEN coalesce(CASE status WHEN 404 THEN 'http_404 page not found' WHEN 403 THEN
   'http_403 forbidden' WHEN 401 THEN 'http_401 unauthorized' WHEN 503 THEN 'http_503 server error' END,
   'insufficient_content') END AS error,
 CASE WHEN length(body) >= need THEN md5(body) END AS digest,
 CASE WHEN length(body) >= need THEN (SELECT count(*) FROM links l WHERE l.seq = c.seq AND length(text) >= 3
   AND NOT starts_with(href, '#') AND NOT regexp_matches(href, '{_NOISE}')) ELSE 0 END AS n_links FROM chosen c""")
def _(spark, d):
    out = J.accept_pages(V.pages(spark, d))
    return out.select("seq", "company", "final_url", "error", F.md5("text").alias("digest"),
                      F.size("links").cast("bigint").alias("n_links"))
