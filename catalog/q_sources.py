"""Readers: profiles, JSON feeds, directories, boards and cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



from joblattice.plans import jobs as J
from joblattice.sources import boards as B
from joblattice.sources import directories as DI
from joblattice.sources import feeds as FE
from joblattice.sources.profile import profile_terms

from . import sql as S
from . import views as V
from .registry import query


def _text(c):
    return F.col(c).cast("string")


# --- profiles ------------------------------------------------------------------------------

@query("s4_profile_terms", """SELECT profile_id, category, term, CAST(pos AS BIGINT) AS pos, CAST(weight AS BIGINT) AS weight, mode FROM (
 SELECT c_custkey AS profile_id, 'role' AS category, c_mktsegment || ' Lead' AS term, 0 AS pos, 5 AS weight, 'any_word_gt3' AS mode FROM customer
 UNION ALL SELECT c_custkey, 'role', 'Nation Desk ' || c_nationkey, 1, 5, 'any_word_gt3' FROM customer
 UNION ALL SELECT c_custkey, 'keyword', lower(c_mktsegment), 0, 2, 'substring' FROM customer
 UNION ALL SELECT c_custkey, 'ops', 'ops' || c_nationkey, 0, 3, 'substring' FROM customer
 UNION ALL SELECT c_custkey, 'tech', 't' || c_nationkey, 0, 2, 'whole_word' FROM customer
 UNION ALL SELECT c_custkey, 'method', 'm' || c_nationkey, 0, 2, 'substring' FROM customer
 UNION ALL SELECT c_custkey, 'exclude', 'x' || c_nationkey, 0, -100, 'substring' FROM customer WHERE c_acctbal < 0
 UNION ALL SELECT c_custkey, 'exclude_company', c_name, 0, 0, 'company' FROM customer)""")
def _(spark, d):
    nation = _text("c_nationkey")

    def words(*cols):
        return F.array(*cols)
    prefs = F.struct(
        words(F.concat("c_mktsegment", F.lit(" Lead")), F.concat(F.lit("Nation Desk "), nation)).alias("roles"),
        words(F.col("c_name")).alias("exclude_companies"),
        F.when(F.col("c_acctbal") < 0, words(F.concat(F.lit("x"), nation))).alias("exclude_keywords"),
        words(F.lower("c_mktsegment")).alias("preferred_keywords"))
    skills = F.struct(words(F.concat(F.lit("ops"), nation)).alias("operations_finance"),
                      words(F.concat(F.lit("t"), nation)).alias("technical"),
                      words(F.concat(F.lit("m"), nation)).alias("methodology"))
    rows = V.table(spark, d, "customer").select(
        F.col("c_custkey").alias("profile_id"), prefs.alias("preferences"),
        F.struct(skills.alias("skills")).alias("cv"))
    return profile_terms(rows)


# --- feeds ---------------------------------------------------------------------------------

def array_payloads(spark, d):
    """One array feed payload per order: metadata and two entries, some payloads malformed."""
    key, amount = _text("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    prio = F.col("o_orderpriority")
    first = F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.concat(F.lit(" Order "), key).alias("position"),
        F.concat(F.lit("Cust "), _text("o_custkey")).alias("company"), F.concat(F.lit("/jobs/"), key).alias("url"),
        F.array(F.lit("a"), F.col("o_orderstatus")).alias("tags"), amount.alias("salary_min"),
        F.concat(F.lit("$"), F.format_number(amount + 1, 0)).alias("salary_max"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.col("o_orderstatus").alias("location"), F.lit("text").alias("description")))
    company = F.when(prio == "5-LOW", F.lit("null")).otherwise(
        F.concat(F.lit('"C'), _text("o_custkey"), F.lit('"')))
    second = F.concat(F.lit('{"position": "B'), key, F.lit('", "company": '), company,
                      F.lit(', "url": "https://x/'), key, F.lit('", "tags": "x, ,y", "location": "  ", "salary_min": "n/a"}'))
    full = F.concat(F.lit('[{"legal": "meta"}, '), first, F.lit(", "), second, F.lit("]"))
    payload = (F.when(prio == "1-URGENT", F.lit('{"error": "busy"}'))
               .when(prio == "2-HIGH", F.lit('[{"legal": "meta"}]')).otherwise(full))
    return V.spread_table(spark, d, "orders", "o_orderkey").select("o_orderkey", payload.alias("payload"))


_S7_ALL = """SELECT o_orderkey, CAST(1 AS BIGINT) AS pos, CAST(o_orderkey AS VARCHAR) AS external_id, 'Order ' || o_orderkey AS title,
  'Cust ' || o_custkey AS company, 'https://remoteok.com/jobs/' || o_orderkey AS url, o_orderstatus AS location,
  CAST(floor(o_totalprice) AS BIGINT) AS salary_min, CAST(floor(o_totalprice) AS BIGINT) + 1 AS salary_max,
  'a|' || o_orderstatus AS tags, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date_posted FROM o
 UNION ALL SELECT o_orderkey, 2, '', 'B' || o_orderkey, 'C' || o_custkey, 'https://x/' || o_orderkey, 'Remote', NULL, NULL,
  'x|y', NULL FROM o WHERE o_orderpriority <> '5-LOW'"""
_S7 = f"WITH o AS (SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) {_S7_ALL}"
_FEED_COLS = ("pos", "external_id", "title", "company", "url", "location", "salary_min", "salary_max")


@query("s7_array_feed", _S7)
def _(spark, d):
    rows = FE.parse_array_feed(array_payloads(spark, d), keep=("o_orderkey",))
    return rows.select("o_orderkey", *_FEED_COLS, F.array_join("tags", "|").alias("tags"), "date_posted")


def object_payloads(spark, d):
    """One object feed payload per part: two jobs, the second without url for small parts."""
    key = _text("p_partkey")
    job = F.struct(
        F.col("p_partkey").alias("id"), F.concat(F.lit("\t"), F.col("p_name")).alias("title"),
        F.col("p_brand").alias("company_name"), F.concat(F.lit("https://r/"), key).alias("url"),
        F.array(F.lit("t"), F.col("p_type")).alias("tags"), F.col("p_type").alias("category"),
        F.concat(F.lit("$"), _text("p_size"), F.lit("k - $"), F.col("p_size").cast("string"), F.lit("k")).alias("salary"),
        F.lit("2024-02-03T04:05:06").alias("publication_date"), F.col("p_type").alias("job_type"),
        F.when(F.col("p_size") > 25, "Worldwide").alias("candidate_required_location"))
    other = F.struct(
        F.lit("Other").alias("title"), F.col("p_brand").alias("company_name"),
        F.when(F.col("p_size") >= 10, F.concat(F.lit("https://o/"), key)).otherwise(" ").alias("url"),
        F.lit("u,v").alias("tags"), F.lit("w").alias("category"))
    payload = F.concat(F.lit('{"jobs": ['), F.to_json(job), F.lit(", "), F.to_json(other), F.lit("]}"))
    return V.spread_table(spark, d, "part", "p_partkey").select("p_partkey", payload.alias("payload"))


_S8_ALL = """SELECT p_partkey, CAST(0 AS BIGINT) AS pos, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, p_brand AS company,
  'https://r/' || p_partkey AS url, CASE WHEN p_size > 25 THEN 'Worldwide' ELSE 'Remote' END AS location,
  CAST(p_size AS BIGINT) * 1000 AS salary_min, CAST(p_size AS BIGINT) * 1000 AS salary_max, 't|' || p_type AS tags,
  '2024-02-03T04:05:06+00:00' AS date_posted, p_type AS job_type FROM part
 UNION ALL SELECT p_partkey, 1, '', 'Other', p_brand, 'https://o/' || p_partkey, 'Remote', NULL, NULL, 'u|v|w', NULL, NULL
 FROM part WHERE p_size >= 10"""


@query("s8_object_feed", _S8_ALL)
def _(spark, d):
    rows = FE.parse_object_feed(object_payloads(spark, d), keep=("p_partkey",))
    return rows.select("p_partkey", *_FEED_COLS, F.array_join("tags", "|").alias("tags"), "date_posted", "job_type")


@query("f19_required_fields", "SELECT 'array' AS feed, count(*) AS n FROM (" + _S7 + ") UNION ALL SELECT 'object', count(*) FROM ("
       + _S8_ALL + ") UNION ALL SELECT 'cards', count(*) FROM part WHERE p_size >= 25")
def _(spark, d):
    n = F.count(F.lit(1)).alias("n")
    parts = {"array": FE.parse_array_feed(array_payloads(spark, d)),
             "object": FE.parse_object_feed(object_payloads(spark, d)),
             "cards": B.parse_board_cards(board_cards(spark, d))}
    rows = [df.agg(n).select(F.lit(k).alias("feed"), "n") for k, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_P1 = f"""WITH o AS (SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')),
 rows_ AS (SELECT 'remoteok' AS source, external_id, title, company, o_orderkey * 8 + pos AS seq FROM ({_S7_ALL})
  UNION ALL SELECT 'remotive', external_id, title, company, {1 << 50} + p_partkey * 8 + pos FROM ({_S8_ALL})),
 hashed AS (SELECT *, lower(trim(title)) || '|' || lower(trim(company)) AS h FROM rows_)"""


def feed_batches(spark, d):
    array_seq = F.col("o_orderkey") * 8 + F.col("pos")
    object_seq = F.lit(1 << 50) + F.col("p_partkey") * 8 + F.col("pos")

    def array_feed():
        return (FE.parse_array_feed(array_payloads(spark, d), keep=("o_orderkey",))
                .withColumns({"seq": array_seq, "date_scraped": V.moment(5)}).drop("pos", "o_orderkey"))

    def object_feed():
        return (FE.parse_object_feed(object_payloads(spark, d), keep=("p_partkey",))
                .withColumns({"seq": object_seq, "date_scraped": V.moment(6)}).drop("pos", "p_partkey"))

    def broken_feed():
        raise ConnectionError("feed not available")
    return {"remoteok": array_feed, "remotive": object_feed, "broken": broken_feed}


# Entries with the same title and company touch; entries without an id share the blank id of
# their source, so only the first of them is inserted.
@query("p1_ingest_feeds", _P1 + """, firsts AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY seq) AS rh,
  row_number() OVER (PARTITION BY source, external_id ORDER BY seq) AS rk FROM hashed),
 ins AS (SELECT source, h, seq FROM firsts WHERE rh = 1 AND rk = 1),
 labelled AS (SELECT f.source, CASE WHEN i.seq = f.seq THEN 'insert' WHEN i.seq < f.seq THEN 'touch' ELSE 'ignored' END AS label
   FROM hashed f LEFT JOIN ins i ON f.h = i.h)
 SELECT source, count(*) AS jobs_found, count(*) FILTER (WHERE label <> 'touch') AS jobs_new, 'completed' AS status
 FROM labelled GROUP BY source UNION ALL SELECT 'broken', 0, 0, 'failed'""")
def _(spark, d):
    stored = V.listings(spark, d).drop("seq").limit(0)
    return J.ingest_feeds(stored, feed_batches(spark, d)).runs.select("source", "jobs_found", "jobs_new", "status")


# --- directories ---------------------------------------------------------------------------

def profile_files(spark, d):
    """One markdown file per customer."""
    head = F.concat(
        F.lit("---\ntitle: \""), F.when(F.col("c_acctbal") > -500, F.col("c_name")).otherwise(""),
        F.lit("\"\nslug: x\nwebsite: 'c"), _text("c_custkey"), F.lit(".example.com'\nremote_policy: old\n"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("careers_url: https://jobs.example.com/"), _text("c_custkey"), F.lit("\n")))
        .otherwise(""), F.lit("remote_policy: remote-first\ncompany_size: "), _text("c_nationkey"),
        F.lit("\ntech:\n  - "), F.lower("c_mktsegment"), F.lit("\n  - sql\n---\nBody - text\n  - not tech\n"))
    plain = F.lit("no frontmatter here\n")
    return V.table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", plain).otherwise(head).alias("text"),
        F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(".md")).alias("file_name"))


_FILES = "(SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY')"


@query("s9_crawl_targets", f"""SELECT replace(lower(c_name), '#', '-') || '.md' AS file_name,
 CASE WHEN c_acctbal > -500 THEN c_name ELSE 'Customer ' || substr(c_name, 10) END AS company,
 CASE WHEN c_acctbal > 5000 THEN 'https://jobs.example.com/' || c_custkey ELSE 'https://c' || c_custkey || '.example.com' END AS careers_url
 FROM {_FILES}""")
def _(spark, d):
    return DI.crawl_targets(profile_files(spark, d))


_S10 = f"""SELECT c_custkey, c_name AS name, 'c' || c_custkey || '.example.com' AS website,
 CASE WHEN c_acctbal > 5000 THEN 'https://jobs.example.com/' || c_custkey END AS careers_url, 'remote-first' AS remote_policy,
 CAST(c_nationkey AS VARCHAR) AS size, lower(c_mktsegment) || '|sql' AS tech FROM {_FILES} WHERE c_acctbal > -500"""


@query("s10_directory_files", _S10)
def _(spark, d):
    rows = DI.parse_profile_files(profile_files(spark, d), ("c_custkey",))
    return rows.select("c_custkey", "name", "website", "careers_url", "remote_policy", "size",
                       F.array_join("tech_stack", "|").alias("tech"))


def table_files(spark, d):
    """Two table rows per supplier, one of them naming a customer."""
    k = _text("s_suppkey")
    text = F.concat(F.lit("| Name | Business | Tech |\n|---|---|---|\n| ["), F.col("s_name"), F.lit("](https://s"), k,
                    F.lit(".example.com) | makes "), _text("s_nationkey"), F.lit(" | go,  ,sql |\n| [Customer#"),
                    F.lpad(k, 9, "0"), F.lit("](http://t"), k, F.lit(") | trade | java |\n"))
    return V.table(spark, d, "supplier").select("s_suppkey", text.alias("text"))


_S11 = """SELECT s_suppkey, CAST(0 AS BIGINT) AS pos, s_name AS name, 'https://s' || s_suppkey || '.example.com' AS website,
  'makes ' || s_nationkey AS description, 'go|sql' AS tech FROM supplier
 UNION ALL SELECT s_suppkey, 1, 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'http://t' || s_suppkey, 'trade', 'java' FROM supplier"""


@query("s11_directory_table", _S11)
def _(spark, d):
    rows = DI.parse_table(table_files(spark, d), ("s_suppkey",))
    return rows.select("s_suppkey", "pos", "name", "website", "description",
                       F.array_join("tech_stack", "|").alias("tech"))


def list_files(spark, d):
    k = _text("s_suppkey")
    text = F.concat(F.lit("[Awesome](https://a) - badge\n1. ["), F.col("s_name"), F.lit("](https://jobs/"), k,
                    F.lit(") – hires in "), _text("s_nationkey"), F.lit("..\n2. [Customer#"), F.lpad(k, 9, "0"),
                    F.lit("](https://cj/"), k, F.lit(") - other<br>\n"))
    return V.table(spark, d, "supplier").select("s_suppkey", text.alias("text"))


_S12 = """SELECT s_suppkey, CAST(1 AS BIGINT) AS pos, s_name AS name, 'https://jobs/' || s_suppkey AS careers_url,
  'hires in ' || s_nationkey AS description FROM supplier
 UNION ALL SELECT s_suppkey, 2, 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'https://cj/' || s_suppkey, 'other' FROM supplier"""


@query("s12_directory_list", _S12)
def _(spark, d):
    return DI.parse_list(list_files(spark, d), ("s_suppkey",)).select(
        "s_suppkey", "pos", "name", "careers_url", "description")


def _directories(spark, d):
    files = DI.parse_profile_files(profile_files(spark, d), ("c_custkey",))
    table = DI.parse_table(table_files(spark, d), ("s_suppkey",))
    listed = DI.parse_list(list_files(spark, d), ("s_suppkey",))
    return (files.withColumn("seq", F.col("c_custkey")).drop("c_custkey"),
            table.withColumn("seq", F.col("s_suppkey") * 8 + F.col("pos")).drop("s_suppkey", "pos"),
            listed.withColumn("seq", F.col("s_suppkey") * 8 + F.col("pos")).drop("s_suppkey", "pos"))


_U2 = f"""dirs AS (SELECT 0 AS source_rank, c_custkey AS seq, name, website, careers_url, NULL AS description, size, remote_policy,
   tech, 'remoteintech' AS source FROM ({_S10})
 UNION ALL SELECT 1, s_suppkey * 8 + pos, name, website, NULL, description, NULL, 'fully-remote', tech, 'yanirs' FROM ({_S11})
 UNION ALL SELECT 2, s_suppkey * 8 + pos, name, NULL, careers_url, description, NULL, 'fully-remote', '', 'fireball' FROM ({_S12}))"""


@query("u2_union_directories", f"WITH {_U2} SELECT CAST(source_rank AS BIGINT) AS source_rank, seq, name, source FROM dirs")
def _(spark, d):
    return DI.union_directories(*_directories(spark, d)).select(
        F.col("source_rank").cast("bigint").alias("source_rank"), "seq", "name", "source")


@query("p2_ingest_directories", f"""WITH {S.COMPANIES}, {_U2}, r AS (
  SELECT CAST(-1 AS HUGEINT) AS o, name, website, careers_url, description, size, remote_policy,
    array_to_string(tech_stack, '|') AS tech, source FROM companies
  UNION ALL SELECT CAST(source_rank AS HUGEINT) * {1 << 60} + seq, name, website, careers_url, description, size, remote_policy, tech, source FROM dirs)
 SELECT name, arg_max(tech, o) AS tech, """ + ", ".join(f"arg_max({c}, o) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in
                                                        ("website", "careers_url", "description", "size", "remote_policy", "source"))
       + " FROM r GROUP BY name")
def _(spark, d):
    merged = J.ingest_directories(V.companies(spark, d), *_directories(spark, d))
    return merged.select("name", F.array_join("tech_stack", "|").alias("tech"), "website", "careers_url", "description",
                         "size", "remote_policy", "source")


# --- boards and cards ----------------------------------------------------------------------

def category_pages(spark, d):
    """One category page per part with two postings; the second repeats across parts.

    Fields hold nested markup, an advert with the posting's classes stands outside the list,
    an item has a second link, and a comment holds a posting.
    """
    k = _text("p_partkey")
    advert = ('<div class="ad"><a class="listing-link--unlocked" href="/ad"><h3 class="'
              'new-listing__header__title__text">Ad</h3><p class="new-listing__company-name">Ad</p></a></div>')

    def item(cls, href, title, company, place, spans):
        return F.concat(F.lit(f'<li><a class="x listing-link--{cls}" href="'), href,
                        F.lit('"><h3 class="new-listing__header__title__text">'), title,
                        F.lit('</h3><p class="new-listing__company-name"><span>'), company,
                        F.lit("</span><i> Ltd </i></p><p class='new-listing__company-headquarters'>"), place, F.lit("</p>"),
                        *[F.concat(F.lit('<p class="new-listing__categories__category">'), s, F.lit("</p>")) for s in spans],
                        F.lit('</a><a class="listing-link--locked" href="/second"></a></li>'))
    one = item("unlocked", F.concat(F.lit("/remote-jobs/"), k), F.concat(F.lit(" "), F.col("p_name"), F.lit(" &amp; co ")),
               F.col("p_brand"), F.lit(""), [F.lit("Featured"), F.col("p_type"), F.lit("Full-Time"), F.lit("Anywhere in the World")])
    two = item("locked", F.concat(F.lit("https://other/"), F.col("p_brand")), F.when(F.col("p_size") > 45, "").otherwise(F.col("p_type")),
               F.lit("Acme"), F.lit("Oslo"), [F.lit("Contract")])
    html = F.concat(F.lit(advert + '<section class="x jobs"><article><ul>'), one, F.lit(f"<!-- <li>{advert}</li> -->"), two,
                    F.lit(f'<li><a href="/other">More</a></li></ul>{advert}</article></section><ul><li>{advert}</li></ul>'))
    path = F.concat(F.lit("/categories/remote-"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit("-jobs"))
    return V.spread_table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("page_id"), path.alias("cat_path"), html.alias("html"))


_CAT = S.title_case("lower(p_type)")
_S13 = f"""SELECT seq, title, company, url, location, tags, job_type FROM (
 SELECT p_partkey AS seq, CAST(0 AS BIGINT) AS pos, p_name || ' & co' AS title, p_brand || 'Ltd' AS company,
   'https://weworkremotely.com/remote-jobs/' || p_partkey AS url, 'Anywhere in the World' AS location,
   p_type || '|Anywhere in the World|' || {_CAT} AS tags, 'full-time' AS job_type FROM part
 UNION ALL SELECT p_partkey, 1, p_type, 'AcmeLtd', 'https://other/' || p_brand, 'Oslo', {_CAT}, 'contract'
 FROM part WHERE p_size <= 45) QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq, pos) = 1"""


@query("s13_category_pages", _S13)
def _(spark, d):
    rows = B.parse_category_pages(category_pages(spark, d))
    return rows.select("seq", "title", "company", "url", "location",
                       F.array_join("tags", "|").alias("tags"), "job_type")


@query("s14_text_cards", """SELECT p_partkey AS seq, p_name AS title, CASE WHEN p_size < 5 THEN 'Unknown' ELSE p_brand END AS company,
 'https://www.dayonejobs.com/jobs/' || p_name AS url, CASE WHEN p_size < 5 THEN 'Unknown' ELSE 'Oslo' END AS location,
 CASE WHEN p_size >= 5 THEN p_type END AS job_type, CASE WHEN p_size >= 5 THEN CAST(p_size AS BIGINT) * 1000 END AS salary_min
 FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1""")
def _(spark, d):
    size = _text("p_size")
    more = F.concat(F.lit("\n"), F.col("p_brand"), F.lit("\n\nLocation\nOslo\nEMPLOYMENT type\n"), F.col("p_type"),
                    F.lit("\nsalary\n$"), size, F.lit(",000 - $"), size, F.lit(",500\n"))
    text = F.concat(F.lit("  "), F.col("p_name"), F.when(F.col("p_size") < 5, "").otherwise(more))
    cards = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq"),
                                             F.concat(F.lit("/jobs/"), F.col("p_name")).alias("href"), text.alias("text"))
    return B.parse_text_cards(cards).select("seq", "title", "company", "url", "location", "job_type", "salary_min")


def titled_cards(spark, d):
    return V.table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_type").alias("page"),
        F.concat(F.lit("/jobs/"), F.col("p_brand")).alias("href"), F.concat(F.lit(" "), F.col("p_name")).alias("title"),
        F.when(F.col("p_size") < 25, " ").otherwise(F.col("p_brand")).alias("company"), F.lit(None).cast("string").alias("location"))


_S15 = """SELECT p_partkey AS seq, p_name AS title, CASE WHEN p_size < 25 THEN 'Unknown' ELSE p_brand END AS company,
 'https://startup.jobs/jobs/' || p_brand AS url, 'Remote' AS location FROM part
 QUALIFY row_number() OVER (PARTITION BY {} ORDER BY p_partkey) = 1"""


@query("s15_titled_cards", _S15.format("p_brand"))
def _(spark, d):
    return B.parse_titled_cards(titled_cards(spark, d)).select("seq", "title", "company", "url", "location")


@query("u3_union_pages", f"SELECT 'categories' AS part, count(*) AS n FROM ({_S13}) UNION ALL "
       f"SELECT 'paged', count(*) FROM ({_S15.format('p_type, p_brand')})")
def _(spark, d):
    # Category pages keep the first url over all pages, paged results only within a page.
    pages = category_pages(spark, d)
    economy = F.col("cat_path").contains("economy")
    whole = B.parse_category_pages(B.union_all([pages.where(economy), pages.where(~economy)]))
    paged = B.parse_titled_cards(titled_cards(spark, d), page="page")
    return (whole.select(F.lit("categories").alias("part")).unionByName(paged.select(F.lit("paged").alias("part")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n")))


def board_cards(spark, d):
    return V.table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") < 25, " ").otherwise(F.col("p_brand")).alias("company"),
        F.when(F.col("p_size") > 40, "Oslo").otherwise("").alias("location"),
        F.when(F.col("p_size") > 30, F.concat(F.lit("/jobs/"), _text("p_partkey"))).otherwise(" ").alias("url"))


@query("s16_board_cards", """SELECT p_partkey AS seq, p_name AS title, p_brand AS company,
 CASE WHEN p_size > 40 THEN 'Oslo' ELSE 'Remote' END AS location,
 CASE WHEN p_size > 30 THEN 'https://wellfound.com/jobs/' || p_partkey ELSE 'https://wellfound.com' END AS url FROM part WHERE p_size >= 25""")
def _(spark, d):
    return B.parse_board_cards(board_cards(spark, d)).select("seq", "title", "company", "location", "url")


@query("s17_link_cards", """SELECT p_partkey AS seq, p_name AS title, 'Unknown' AS company,
 'https://remotefirstjobs.com/job/' || p_brand AS url FROM part WHERE length(p_name) >= 9
 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1""")
def _(spark, d):
    title = F.when(F.length("p_name") >= 9, F.col("p_name")).otherwise(F.left("p_name", F.lit(4)))
    cards = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), title.alias("title"),
                                             F.concat(F.lit("/job/"), F.col("p_brand")).alias("url"))
    return B.parse_link_cards(cards).select("seq", "title", "company", "url")


@query("s18_line_cards", """SELECT p_partkey AS seq, p_name AS title, CASE WHEN p_size < 25 THEN 'Unknown' ELSE p_brand END AS company,
 'https://www.trueup.io/job/' || p_brand AS url FROM part""")
def _(spark, d):
    title = F.when(F.col("p_size") < 25, F.col("p_name")).otherwise(F.concat("p_name", F.lit("\n"), F.col("p_brand"), F.lit("\nx")))
    cards = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), title.alias("title"),
                                             F.concat(F.lit("/job/"), F.col("p_brand")).alias("url"))
    return B.parse_line_cards(cards).select("seq", "title", "company", "url")


# --- cards read from stored markup -----------------------------------------------------------

def _markup(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _part_pages(spark, d, html):
    return V.spread_table(spark, d, "part", "p_partkey").select(
        F.col("p_partkey").alias("page_id"), html.alias("html"))


@query("s15_titled_cards_html", """SELECT p_partkey AS page_id, p_name AS title, CASE WHEN p_size < 25 THEN 'Unknown'
 ELSE p_brand || ' Inc' END AS company, 'https://startup.jobs/jobs/' || p_partkey AS url, CASE WHEN p_size > 40 THEN 'Oslo' ELSE 'Remote' END AS location
 FROM part UNION ALL SELECT p_partkey, 'Plain ' || p_brand, 'Unknown', 'https://startup.jobs/jobs/x', 'Remote' FROM part""")
def _(spark, d):
    company = F.when(F.col("p_size") < 25, "").otherwise(_markup(
        '<div class="company"><div><b>', F.col("p_brand"), "</b> Inc</div></div>"))
    place = F.when(F.col("p_size") > 40, '<span class="job-location">Oslo</span>').otherwise("")
    html = _markup('<main><article class="job-card big"><h2>', F.col("p_name"), "</h2>", company, place,
                   '<a href="/jobs/', _text("p_partkey"), '">Apply</a></article><p class="company">Outside</p>',
                   '<section class="job-listing"><a href="/jobs/x">Plain <i>', F.col("p_brand"), "</i></a></section>",
                   '<section class="job-listing"><a href="/jobs/">All</a></section></main>')
    cards = B.titled_cards(_part_pages(spark, d, html))
    return B.parse_titled_cards(cards, page="page_id").select("page_id", "title", "company", "url", "location")


@query("s16_board_cards_html", """SELECT p_partkey AS page_id, p_name AS title, p_brand || ' & Co' AS company,
 CASE WHEN p_size > 40 THEN 'Oslo' ELSE 'Remote' END AS location, CASE WHEN p_size > 30 THEN 'https://wellfound.com/jobs/' || p_partkey
 ELSE 'https://wellfound.com' END AS url FROM part WHERE p_size >= 25""")
def _(spark, d):
    title = F.when(F.col("p_size") > 30, _markup('<a href="/jobs/', _text("p_partkey"), '"><div>', F.col("p_name"), "</div></a>")
                   ).otherwise(_markup("<h3>", F.col("p_name"), "</h3>"))
    company = F.when(F.col("p_size") >= 25, _markup('<div class="styles_company__x"><div><span>', F.col("p_brand"),
                                                    "</span> &amp; Co</div></div>")).otherwise("")
    place = F.when(F.col("p_size") > 40, '<span class="styles_Location">Oslo</span>').otherwise("")
    html = _markup('<div class="company">Outside</div><div class="x JobListing_y">', title, "<div>", company, "</div>", place,
                   '</div><div class="location">Outside</div>')
    return _with_page(B.board_cards(_part_pages(spark, d, html)), B.parse_board_cards)


def _with_page(cards, parse):
    """Parsed cards with their page; every page holds one card."""
    rows = parse(cards.withColumn("seq", F.col("page_id")), "seq")
    return rows.select(F.col("seq").alias("page_id"), "title", "company", "location", "url")


@query("s18_line_cards_html", """SELECT p_partkey AS page_id, p_name AS title, CASE WHEN p_size < 25 THEN 'Unknown' ELSE p_brand END AS company,
 'Remote' AS location, 'https://www.trueup.io/job/' || p_partkey AS url FROM part""")
def _(spark, d):
    company = F.when(F.col("p_size") < 25, "").otherwise(_markup("<p>", F.col("p_brand"), "</p>"))
    html = _markup('<nav><a href="/jobs">Jobs page</a></nav><a class=row href=/job/', _text("p_partkey"), "><div><b>",
                   F.col("p_name"), "</b></div>", company, "</a><p>After</p>")
    return _with_page(B.link_cards(_part_pages(spark, d, html), path="/job/"), B.parse_line_cards)


@query("s17_link_cards_html", """SELECT p_partkey AS page_id, p_name AS title, 'Unknown' AS company, 'Remote' AS location,
 'https://remotefirstjobs.com/jobs/' || p_partkey AS url FROM part""")
def _(spark, d):
    html = _markup('<a href="/about">About us all</a><ul><li><a href="/jobs/', _text("p_partkey"), '">', F.col("p_name"),
                   '</a></li><li><a href="/jobs/9">Four</a>')
    return _with_page(B.link_cards(_part_pages(spark, d, html)), B.parse_link_cards)


# --- every feed in one ingest ------------------------------------------------------------------

def text_cards(spark, d):
    return V.table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("/jobs/"), F.col("p_name")).alias("href"),
        F.concat("p_name", F.lit("\n"), "p_brand").alias("text"))


def url_cards(spark, d, title, where="true"):
    return V.table(spark, d, "part").where(where).select(
        F.col("p_partkey").alias("seq"), title.alias("title"), F.concat(F.lit("/job/"), _text("p_partkey")).alias("url"))


def every_feed(spark, d):
    """Eight feeds in the order of their runs, one that fails in its last rows, one without rows
    and one that cannot be reached."""
    lines = F.concat("p_name", F.lit("\n"), "p_brand", F.lit("\nx"))

    def dated(rows):
        return lambda: rows().withColumn("date_scraped", V.moment(5))

    def breaks_late():
        rows = B.parse_line_cards(url_cards(spark, d, lines))
        return rows.withColumn("title", F.when(F.col("seq") > 150, F.raise_error(F.lit("page broke"))).otherwise(F.col("title")))

    def unreachable():
        raise ConnectionError("feed not available")
    feeds = {
        "remoteok": lambda: FE.parse_array_feed(array_payloads(spark, d), keep=("o_orderkey",)).withColumnRenamed("o_orderkey", "seq"),
        "remotive": lambda: FE.parse_object_feed(object_payloads(spark, d), keep=("p_partkey",)).withColumnRenamed("p_partkey", "seq"),
        "weworkremotely": lambda: B.parse_category_pages(category_pages(spark, d)),
        "late": breaks_late,
        "startupjobs": lambda: B.parse_titled_cards(titled_cards(spark, d)),
        "dayonejobs": lambda: B.parse_text_cards(text_cards(spark, d)),
        "nothing": lambda: B.parse_link_cards(url_cards(spark, d, F.col("p_name"), "false")),
        "wellfound": lambda: B.parse_board_cards(board_cards(spark, d)),
        "trueup": lambda: B.parse_line_cards(url_cards(spark, d, lines)),
        "gone": unreachable,
        "remotefirstjobs": lambda: B.parse_link_cards(url_cards(spark, d, F.col("p_name")))}
    return {name: dated(read) for name, read in feeds.items()}


# External ids: cards of three boards have none, so only their hashes can be met again.
_EVERY = f"""WITH o AS (SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')),
 rows_ AS (SELECT 1 AS run, o_orderkey AS seq, pos, external_id AS ext, title, company FROM ({_S7_ALL})
  UNION ALL SELECT 2, p_partkey, pos, external_id, title, company FROM ({_S8_ALL})
  UNION ALL SELECT 3, seq, CASE WHEN company = 'AcmeLtd' THEN 1 ELSE 0 END, url, title, company FROM ({_S13})
  UNION ALL SELECT 5, seq, 0, url, title, company FROM ({_S15.format("p_brand")})
  UNION ALL SELECT 6, p_partkey, 0, p_name, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1
  UNION ALL SELECT 8, p_partkey, 0, NULL, p_name, p_brand FROM part WHERE p_size >= 25
  UNION ALL SELECT 9, p_partkey, 0, NULL, p_name, p_brand FROM part
  UNION ALL SELECT 11, p_partkey, 0, NULL, p_name, 'Unknown' FROM part WHERE length(p_name) >= 5),
 hashed AS (SELECT *, lower(trim(title)) || '|' || lower(trim(company)) AS h, row_number() OVER (ORDER BY run, seq, pos) AS n FROM rows_),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n) AS rh, row_number() OVER (PARTITION BY run, ext ORDER BY n) AS rk FROM hashed),
 ins AS (SELECT h, n FROM firsts WHERE rh = 1 AND (rk = 1 OR ext IS NULL)),
 labelled AS (SELECT f.run, i.n IS NULL OR i.n >= f.n AS new FROM hashed f LEFT JOIN ins i ON f.h = i.h),
 names AS (SELECT * FROM (VALUES (1, 'remoteok'), (2, 'remotive'), (3, 'weworkremotely'), (4, 'late'), (5, 'startupjobs'), (6, 'dayonejobs'),
  (7, 'nothing'), (8, 'wellfound'), (9, 'trueup'), (10, 'gone'), (11, 'remotefirstjobs')) AS t(id, source))"""


@query("p1_every_feed", _EVERY + """ SELECT CAST(id AS BIGINT) AS id, source, count(run) AS jobs_found, count(*) FILTER (WHERE new) AS jobs_new,
 CASE WHEN source IN ('late', 'gone') THEN 'failed' ELSE 'completed' END AS status, source IN ('late', 'gone') AS has_error, TRUE AS finished
 FROM names LEFT JOIN labelled ON run = id GROUP BY id, source""")
def _(spark, d):
    runs = J.ingest_feeds(V.listings(spark, d).drop("seq").limit(0), every_feed(spark, d)).runs
    return runs.select("id", "source", "jobs_found", "jobs_new", "status", F.col("error_message").isNotNull().alias("has_error"),
                       (F.col("finished_at") >= F.col("started_at")).alias("finished"))
