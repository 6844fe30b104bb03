"""Filters, search, statistics, order and upkeep of listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblattice.functions import text as T
from joblattice.functions.money import salary_display
from joblattice.operators import companies as C
from joblattice.operators import listings as L
from joblattice.operators import ranking as R
from joblattice.sinks.files import markdown_lines
from joblattice.sources.snapshots import active_listings, scorable_listings

from . import sql as S
from . import views as V
from .registry import query

W = f"WITH {S.LISTINGS} "
NEWEST = "ORDER BY scraped DESC, id"


def _like(col: str, needle: str) -> str:
    return f"coalesce(contains(lower({col}), {S.quote(needle)}), false)"


def _tag_like(needle: str) -> str:
    return f"len(list_filter(tags, lambda t: contains(lower(t), {S.quote(needle)}))) > 0"


def _brief(df):
    return df.select("id", "title", "company", "url")


BRIEF = "id, title, company, url"


@query("s5_active_listings", W + f"SELECT {BRIEF}, scraped AS date_scraped FROM listings WHERE is_active")
def _(spark, d):
    return active_listings(V.listings(spark, d)).select(
        "id", "title", "company", "url", V.epoch("date_scraped"))


@query("s6_scorable_listings", W + f"SELECT {BRIEF} FROM listings WHERE is_active "
       "AND (description IS NOT NULL OR title IS NOT NULL)")
def _(spark, d):
    return _brief(scorable_listings(V.listings(spark, d)))


@query("f1_active", W + "SELECT id, source FROM listings WHERE is_active")
def _(spark, d):
    return V.listings(spark, d).where(L.is_active()).select("id", "source")


_F2 = f"({_like('title', 'tion')} OR {_like('description', 'tion')} OR {_tag_like('tion')})"


@query("f2_free_text", W + f"SELECT {BRIEF} FROM listings WHERE {_F2}")
def _(spark, d):
    return _brief(V.text_listings(spark, d).where(L.matches_query("TION")))


@query("f3_source", W + f"SELECT {BRIEF} FROM listings WHERE source = 'src7'")
def _(spark, d):
    return _brief(V.listings(spark, d).where(L.from_source("src7")))


@query("f4_remote_only", W + f"SELECT {BRIEF} FROM listings WHERE {_like('location', 'remote')}")
def _(spark, d):
    return _brief(V.listings(spark, d).where(L.is_remote()))


@query("f5_salary_floor", W + f"SELECT {BRIEF} FROM listings WHERE salary_max >= 30000")
def _(spark, d):
    return _brief(V.listings(spark, d).where(L.pays_at_least(30000)))


@query("f6_search", W + f"SELECT {BRIEF}, scraped AS date_scraped FROM listings WHERE is_active "
       f"AND {_F2} AND {_like('location', 'remote')} AND salary_max >= 20000 {NEWEST} LIMIT 50")
def _(spark, d):
    found = L.search(V.text_listings(spark, d), "tion", remote_only=True, salary_min=20000)
    return found.select("id", "title", "company", "url", V.epoch("date_scraped"))


@query("f6_search_source", W + f"SELECT {BRIEF} FROM listings WHERE is_active AND source = 'src3' "
       f"{NEWEST} LIMIT 20")
def _(spark, d):
    return _brief(L.search(V.listings(spark, d), source="src3", limit=20))


@query("f7_remote_first", f"WITH {S.COMPANIES} SELECT name, remote_policy FROM companies "
       "WHERE remote_policy IN ('fully-remote', 'remote-first')")
def _(spark, d):
    return V.companies(spark, d).where(C.is_remote_first()).select("name", "remote_policy")


@query("f8_tech_stack", f"WITH {S.COMPANIES} SELECT name, tech_stack[1] AS tech FROM companies "
       "WHERE len(list_filter(tech_stack, lambda t: contains(lower(t), 'mach'))) > 0")
def _(spark, d):
    return V.companies(spark, d).where(C.uses_tech("MACH")).select(
        "name", F.element_at("tech_stack", 1).alias("tech"))


_F9 = f"({_like('title', 'src1')} OR {_like('company', 'src1')} OR {_tag_like('src1')})"


@query("f9_export_filter", W + f"SELECT {BRIEF} FROM listings WHERE {_F9}")
def _(spark, d):
    return _brief(V.listings(spark, d).where(L.matches_export_query("src1")))


@query("f23_directory", f"WITH {S.COMPANIES} SELECT name, website, remote_policy, "
       "array_to_string(tech_stack, ',') AS tech, source FROM companies "
       "WHERE remote_policy IN ('fully-remote', 'remote-first') AND len(list_filter(tech_stack, "
       "lambda t: contains(lower(t), 'n1'))) > 0 ORDER BY name LIMIT 30")
def _(spark, d):
    rows = C.directory(V.companies(spark, d), remote_first=True, tech="n1")
    return rows.select("name", "website", "remote_policy",
                       F.array_join("tech_stack", ",").alias("tech"), "source")


@query("o1_newest_first", W + f"SELECT id, scraped AS date_scraped FROM listings {NEWEST} LIMIT 100")
def _(spark, d):
    return R.top_k(V.listings(spark, d), 100, *L.newest_first()).select("id", V.epoch("date_scraped"))


@query("o2_count_order", W + "SELECT company, count(*) AS cnt FROM listings WHERE is_active "
       "GROUP BY company ORDER BY cnt DESC, company LIMIT 25")
def _(spark, d):
    return L.count_by(V.listings(spark, d), "company", 25)


@query("o3_companies_by_name", f"WITH {S.COMPANIES} SELECT name, website, source FROM companies "
       "ORDER BY name LIMIT 30")
def _(spark, d):
    return C.directory(V.companies(spark, d)).select("name", "website", "source")


@query("a1_active_count", W + "SELECT count(*) AS total_active FROM listings WHERE is_active")
def _(spark, d):
    return L.active_count(V.listings(spark, d))


@query("a2_count_by_source", W + "SELECT source, count(*) AS cnt FROM listings WHERE is_active "
       "GROUP BY source ORDER BY cnt DESC, source")
def _(spark, d):
    return L.count_by(V.listings(spark, d), "source")


@query("a3_top_companies", W + "SELECT company, count(*) AS cnt FROM listings WHERE is_active "
       "GROUP BY company ORDER BY cnt DESC, company LIMIT 10")
def _(spark, d):
    return L.count_by(V.listings(spark, d), "company", 10)


_LATEST = "(SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 1)"
_STATS = f"""WITH {S.LISTINGS}, {S.RUNS}, act AS (SELECT * FROM listings WHERE is_active),
 top AS (SELECT company, count(*) AS n FROM act GROUP BY company ORDER BY n DESC, company LIMIT 10)
SELECT 'total_active' AS section, 'all' AS key, count(*) AS value FROM act
UNION ALL SELECT 'by_source', source, count(*) FROM act GROUP BY source
UNION ALL SELECT 'top_companies', company, n FROM top
UNION ALL SELECT 'latest_run_found', source, jobs_found FROM {_LATEST}
UNION ALL SELECT 'latest_run_new', source, jobs_new FROM {_LATEST}"""


@query("a12_stats", _STATS)
def _(spark, d):
    return L.stats(V.listings(spark, d), V.runs(spark, d))


@query("p10_search_stats_export", _STATS + f""" UNION ALL SELECT 'stale', 'marked', count(*) FROM act
 WHERE scraped < {S.EPOCH0} + 400 * 3600
UNION ALL SELECT 'search', title, id FROM (SELECT * FROM act WHERE {_F2} {NEWEST} LIMIT 20)
UNION ALL SELECT 'export', company, id FROM (SELECT * FROM act WHERE {_F9} {NEWEST} LIMIT 5000)""")
def _(spark, d):
    rows = V.listings(spark, d)

    def part(df, section, key, value):
        return df.select(F.lit(section).alias("section"), key.alias("key"), value.alias("value"))
    stale = L.stale_count(L.mark_stale(rows, V.moment(400 + 30 * 24)))
    return (L.stats(rows, V.runs(spark, d))
            .unionByName(part(stale, "stale", F.lit("marked"), F.col("marked")))
            .unionByName(part(L.search(rows, "tion", limit=20), "search", F.col("title"), F.col("id")))
            .unionByName(part(L.export_rows(rows, "src1"), "export", F.col("company"), F.col("id"))))


@query("w4_latest_run", f"WITH {S.RUNS} SELECT id, source, jobs_found, jobs_new, status FROM runs "
       "ORDER BY started_at DESC, id DESC LIMIT 1")
def _(spark, d):
    return L.latest_run(V.runs(spark, d)).select("id", "source", "jobs_found", "jobs_new", "status")


@query("w4_latest_run_per_source", f"WITH {S.RUNS} SELECT source, id, jobs_found, jobs_new FROM runs "
       "QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) = 1")
def _(spark, d):
    return L.latest_run_per_source(V.runs(spark, d)).select("source", "id", "jobs_found", "jobs_new")


@query("j10_mark_stale", W + f"SELECT id, is_active AND scraped >= {S.EPOCH0} + 400 * 3600 AS is_active, "
       f"is_active AND scraped < {S.EPOCH0} + 400 * 3600 AS was_stale FROM listings")
def _(spark, d):
    return L.mark_stale(V.listings(spark, d), V.moment(400 + 30 * 24)).select(
        "id", "is_active", "was_stale")


@query("x2_region", W + f"""SELECT id, location FROM listings WHERE coalesce(regexp_matches(location,
 '(?i)(^|[^\\p{{L}}\\p{{N}}_])({"|".join(L.EU_TERMS)})($|[^\\p{{L}}\\p{{N}}_])'), false)""")
def _(spark, d):
    return V.listings(spark, d).where(L.in_region()).select("id", "location")


@query("x3_last_days", W + f"SELECT id, title FROM listings WHERE is_active "
       f"AND scraped >= {S.EPOCH0} + (900 - 7 * 24) * 3600 {NEWEST} LIMIT 5000")
def _(spark, d):
    return L.export_rows(V.listings(spark, d), last_days=7, as_of=V.moment(900)).select("id", "title")


@query("x4_new_today", W + f"SELECT count(*) AS new_listings FROM listings WHERE is_active "
       f"AND scraped >= {S.EPOCH0} + 500 * 3600")
def _(spark, d):
    return L.new_since(V.listings(spark, d), V.moment(500))


@query("x4_top_tags", W + "SELECT tag, count(*) AS cnt FROM (SELECT unnest(tags) AS tag FROM listings "
       "WHERE is_active) GROUP BY tag ORDER BY cnt DESC, tag LIMIT 15")
def _(spark, d):
    return L.top_tags(V.listings(spark, d), 15)


@query("x1_link_companies", f"WITH {S.COMPANIES}, {S.COMPANY_BATCH} "
       "SELECT b.seq, b.name AS company, c.name AS company_name, c.remote_policy AS company_policy "
       "FROM company_batch b LEFT JOIN companies c ON lower(b.name) = lower(c.name)")
def _(spark, d):
    jobs = V.company_batch(spark, d).select("seq", F.concat(F.lit(" "), F.upper("name"), F.lit("\t"))
                                            .alias("company"))
    linked = C.link_companies(jobs, V.companies(spark, d))
    return linked.withColumn("company", F.replace(T.strip(F.col("company")), F.lit("CUSTOMER"),
                                                  F.lit("Customer")))


def _money(x: str) -> str:
    return f"CASE WHEN coalesce({x}, 0) <> 0 THEN '$' || format('{{:,}}', {x}) ELSE '?' END"


def _salary(sep: str) -> str:
    return (f"CASE WHEN coalesce(salary_min, 0) = 0 AND coalesce(salary_max, 0) = 0 THEN '' "
            f"ELSE {_money('salary_min')} || '{sep}' || {_money('salary_max')} END")


@query("c10_salary_display", W + f"SELECT id, {_salary(' - ')} AS plain, {_salary('–')} AS tight, "
       f"{_salary(' – ')} AS wide FROM listings")
def _(spark, d):
    lo, hi = F.col("salary_min"), F.col("salary_max")
    return V.listings(spark, d).select(
        "id", salary_display(lo, hi).alias("plain"), salary_display(lo, hi, "–").alias("tight"),
        salary_display(lo, hi, " – ").alias("wide"))


_MD = (f"'| [' || title || '](' || url || ') | ' || company || ' | ' || "
       f"coalesce(nullif(location, ''), '—') || ' | ' || {_salary('–')} || ' | ' || source || ' |'")


@query("c20_markdown_row", W + f"SELECT id, {_MD} AS line FROM listings")
def _(spark, d):
    salary = salary_display(F.col("salary_min"), F.col("salary_max"), "–")
    return V.listings(spark, d).select("id", T.markdown_row(
        F.col("title"), F.col("url"), F.col("company"), F.col("location"), salary,
        F.col("source")).alias("line"))


@query("k3_export_markdown", W + f"SELECT {_MD} AS line FROM listings WHERE is_active AND {_F9} "
       f"{NEWEST} LIMIT 200")
def _(spark, d):
    return markdown_lines(L.export_rows(V.listings(spark, d), "src1", 200))


@query("k1_export_csv", W + "SELECT id, title, company, '[\"' || array_to_string(tags, '\", \"') || '\"]' "
       f"AS tags FROM listings WHERE is_active AND {_F9} {NEWEST} LIMIT 5000")
def _(spark, d):
    from joblattice.sinks.files import export_csv
    from joblattice.session import new_folder
    path = new_folder(spark, "csv")
    export_csv(V.listings(spark, d).drop("description"), path, "src1")
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            .select(F.col("id").cast("bigint").alias("id"), "title", "company", "tags"))


@query("k2_export_json", W + "SELECT id, title, company, array_to_string(tags, '|') AS tags, salary_min "
       f"FROM listings WHERE is_active AND {_F9} {NEWEST} LIMIT 5000")
def _(spark, d):
    from joblattice.schemas import LISTING
    from joblattice.session import new_folder
    from joblattice.sinks.files import export_json
    path = new_folder(spark, "json")
    export_json(V.listings(spark, d), path, "src1")
    return spark.read.schema(LISTING).json(path).select(
        "id", "title", "company", F.array_join("tags", "|").alias("tags"), "salary_min")


@query("k9_write_snapshot", W + "SELECT source, count(*) AS n, sum(id) AS ids, "
       "count(*) FILTER (WHERE is_active) AS active FROM listings GROUP BY source")
def _(spark, d):
    from joblattice.session import new_folder
    from joblattice.sinks.files import write_listings
    from joblattice.sources.snapshots import read_listings
    path = new_folder(spark, "listings")
    write_listings(V.listings(spark, d).drop("seq"), path)
    return read_listings(spark, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"),
        F.count_if("is_active").alias("active"))
