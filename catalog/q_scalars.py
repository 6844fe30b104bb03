"""Scalar functions over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblattice.functions import dates as D
from joblattice.functions import money as M
from joblattice.functions import text as T
from joblattice.functions import urls as U
from joblattice.functions.similarity import sorted_tokens

from . import sql as S
from . import views as V
from .registry import query

W = f"WITH {S.LISTINGS} "
_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"


@query("c1_dedup_hash", W + "SELECT id, dedup_hash FROM listings")
def _(spark, d):
    # Outer blanks do not matter.
    title = F.concat(F.lit("\t"), F.col("title"), F.lit(" "))
    return V.listings(spark, d).select("id", T.dedup_hash(title, F.col("company")).alias("dedup_hash"))


_NOISY = """CASE lang WHEN 'en' THEN title || '  (Remote, EU)' WHEN 'de' THEN '  ' || title || ' [m/w/d]'
  WHEN 'fr' THEN title || '   (Platform)' ELSE title END"""
_DOCS = "(SELECT l.*, d.lang FROM listings l JOIN documents d ON d.doc_id = l.id)"


def _with_lang(spark, d):
    return V.listings(spark, d).withColumn("lang", F.element_at("tags", 1))


@query("c2_normalize_title", W + f"SELECT id, {S.strip('''regexp_replace(regexp_replace(noisy,
 '(?i)\\s*[\\(\\[].*(remote|hybrid|contract|full[- ]?time|part[- ]?time|m/f/d|m/w/d|h/f|all genders).*[\\)\\]]', '', 'g'),
 '\\s+', ' ', 'g')''')} AS title FROM (SELECT id, {_NOISY} AS noisy FROM {_DOCS})")
def _(spark, d):
    t, lang = F.col("title"), F.col("lang")
    noisy = (F.when(lang == "en", F.concat(t, F.lit("  (Remote, EU)")))
             .when(lang == "de", F.concat(F.lit("  "), t, F.lit(" [m/w/d]")))
             .when(lang == "fr", F.concat(t, F.lit("   (Platform)"))).otherwise(t))
    return _with_lang(spark, d).select("id", T.normalize_title(noisy).alias("title"))


@query("c3_normalize_tags", W + "SELECT id, lower(tags[1]) || '|' || lower(tags[2]) || '|' || lower(tags[4]) AS tags "
       "FROM listings")
def _(spark, d):
    # The third tag repeats the first in capitals between blanks.
    rows = V.listings(spark, d)
    return rows.select("id", F.array_join(T.normalize_tags(F.array_append("tags", F.lit(" \t"))), "|").alias("tags"))


@query("c4_normalize_location", W + """SELECT id, CASE WHEN loc = '' THEN 'Remote'
 WHEN lower(loc) IN ('worldwide', 'anywhere', 'global', 'remote - worldwide', 'remote - anywhere', 'remote - global')
   THEN 'Remote (Worldwide)' WHEN lower(loc) IN ('remote', 'remote - remote') THEN 'Remote'
 WHEN NOT contains(lower(loc), 'remote') THEN 'Remote (' || loc || ')' ELSE loc END AS location
 FROM (SELECT id, trim(CASE source WHEN 'src1' THEN 'REMOTE - Global ' WHEN 'src2' THEN ' worldwide'
   ELSE coalesce(location, '') END) AS loc FROM listings)""")
def _(spark, d):
    s = F.col("source")
    loc = (F.when(s == "src1", "REMOTE - Global ").when(s == "src2", " worldwide")
           .otherwise(F.coalesce("location", F.lit(""))))
    return V.listings(spark, d).select("id", T.normalize_location(loc).alias("location"))


def _level(x: str) -> str:
    words = (("junior", r"junior|jr\.?|entry[- ]?level|associate"), ("mid", r"mid[- ]?level|intermediate"),
             ("senior", r"senior|sr\.?|principal|staff"), ("lead", "lead|head|director|vp|chief|manager"))
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){_EDGE_L}({w}){_EDGE_R}') THEN '{n}'"
                              for n, w in words) + " END"


_TITLED = """CASE source WHEN 'src1' THEN 'Senior ' || title WHEN 'src2' THEN title || ' Associate Director'
 WHEN 'src3' THEN 'Mid-Level ' || title WHEN 'src4' THEN title || ', Head' ELSE title END"""
_DESC = "CASE source WHEN 'src5' THEN 'we need a senior hand. ' || description ELSE description END"


@query("c5_experience_level", W + f"SELECT id, coalesce({_level('t')}, {_level('substr(s, 1, 500)')}) AS level "
       f"FROM (SELECT id, {_TITLED} AS t, {_DESC} AS s FROM listings)")
def _(spark, d):
    s, t = F.col("source"), F.col("title")
    title = (F.when(s == "src1", F.concat(F.lit("Senior "), t))
             .when(s == "src2", F.concat(t, F.lit(" Associate Director")))
             .when(s == "src3", F.concat(F.lit("Mid-Level "), t)).when(s == "src4", F.concat(t, F.lit(", Head")))
             .otherwise(t))
    desc = F.when(s == "src5", F.concat(F.lit("we need a senior hand. "), F.col("description"))).otherwise(
        F.col("description"))
    return V.listings(spark, d).select("id", T.experience_level(title, desc).alias("level"))


@query("c6_job_type", W + """SELECT id, CASE job_type WHEN 'Full_Time' THEN 'full-time' WHEN 'freelance' THEN 'contract'
 WHEN '' THEN NULL ELSE job_type END AS job_type FROM listings""")
def _(spark, d):
    return V.listings(spark, d).select("id", T.normalize_job_type(F.col("job_type")).alias("job_type"))


_O = "CAST(floor(o_totalprice) AS BIGINT)"


def _prio(value: str):
    return F.col("o_orderpriority") == value


def _orders(spark, d):
    amount = F.floor("o_totalprice").cast("bigint")
    return V.table(spark, d, "orders").withColumns({"amount": amount, "shown": F.format_number(amount, 0)})


@query("c7_parse_amount", f"""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN {_O} WHEN '2-HIGH' THEN {_O}
 END AS amount FROM orders""")
def _(spark, d):
    raw = (F.when(_prio("1-URGENT"), F.concat(F.lit(" $"), F.col("shown")))
           .when(_prio("2-HIGH"), F.col("amount").cast("string"))
           .when(_prio("3-MEDIUM"), F.concat(F.col("amount").cast("string"), F.lit(".5")))
           .when(_prio("5-LOW"), "n/a"))
    return _orders(spark, d).select("o_orderkey", M.parse_amount(raw).alias("amount"))


@query("c8_parse_k_range", f"""SELECT o_orderkey,
 CASE o_orderpriority WHEN '1-URGENT' THEN a // 1000 * 1000 WHEN '2-HIGH' THEN a WHEN '3-MEDIUM' THEN a * 1000
   WHEN '5-LOW' THEN NULL ELSE CASE WHEN a < 1000 THEN a * 1000 ELSE a END END AS lo,
 CASE o_orderpriority WHEN '1-URGENT' THEN (a // 1000 + 5) * 1000 WHEN '2-HIGH' THEN a WHEN '3-MEDIUM' THEN a * 1000
   WHEN '5-LOW' THEN NULL ELSE CASE WHEN a < 1000 THEN a * 1000 ELSE a END END AS hi
 FROM (SELECT *, {_O} AS a FROM orders)""")
def _(spark, d):
    k = F.floor(F.col("amount") / 1000)
    text = F.col("shown")
    raw = (F.when(_prio("1-URGENT"), F.concat(F.lit("$"), k.cast("string"), F.lit("k - $"),
                                                (k + 5).cast("string"), F.lit("k")))
           .when(_prio("2-HIGH"), F.concat(F.lit("$"), text, F.lit(" - $"), text))
           .when(_prio("3-MEDIUM"), F.concat(text, F.lit(" - "), text, F.lit(" per week")))
           .when(_prio("5-LOW"), "competitive").otherwise(F.concat(text, F.lit(" – "), text)))
    lo, hi = M.parse_k_range(raw)
    return _orders(spark, d).select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


@query("c9_parse_int_range", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE {_O} END AS lo,
 CASE WHEN o_orderstatus = 'F' THEN NULL ELSE {_O} + 1000 END AS hi FROM orders""")
def _(spark, d):
    top = F.format_number(F.col("amount") + 1000, 0)
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.col("amount").cast("string"), F.lit("k - 9k"))).otherwise(
        F.concat(F.lit("$"), F.col("shown"), F.lit(" – $"), top))
    lo, hi = M.parse_int_range(raw)
    return _orders(spark, d).select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = (F.when(_prio("1-URGENT"), F.concat(day, F.lit("T10:20:30Z")))
           .when(_prio("2-HIGH"), F.concat(day, F.lit(" 10:20:30.125+02:00")))
           .when(_prio("3-MEDIUM"), day).when(_prio("5-LOW"), "last week")
           .otherwise(F.concat(day, F.lit("T08:00"))))
    return V.table(spark, d, "orders").withColumn("raw", raw)


@query("c11_iso_keep_offset", f"""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN {_DAY} || 'T10:20:30+00:00'
 WHEN '2-HIGH' THEN {_DAY} || 'T10:20:30.125000+02:00' WHEN '3-MEDIUM' THEN {_DAY} || 'T00:00:00'
 WHEN '5-LOW' THEN 'last week' ELSE {_DAY} || 'T08:00:00' END AS posted FROM orders""")
def _(spark, d):
    return _dates(spark, d).select("o_orderkey", D.iso_keep_offset(F.col("raw")).alias("posted"))


@query("c12_iso_as_utc", f"""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN {_DAY} || 'T10:20:30+00:00'
 WHEN '2-HIGH' THEN {_DAY} || 'T10:20:30.125000+00:00' WHEN '3-MEDIUM' THEN {_DAY} || 'T00:00:00+00:00'
 WHEN '5-LOW' THEN 'last week' ELSE {_DAY} || 'T08:00:00+00:00' END AS posted FROM orders""")
def _(spark, d):
    return _dates(spark, d).select("o_orderkey", D.iso_as_utc(F.col("raw")).alias("posted"))


@query("c40_scrape_stamp", W + "SELECT id, strftime(make_timestamp(scraped * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM listings")
def _(spark, d):
    return V.listings(spark, d).select("id", D.iso_seconds(F.col("date_scraped")).alias("stamp"))


@query("c13_split_list", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS tags FROM part")
def _(spark, d):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ,")), F.lit(", "))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(T.split_list(raw), "|").alias("tags"))


@query("c14_append_category", "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), lower(p_brand)) OR p_size < 10 "
       "THEN replace(p_name, ' ', '|') ELSE replace(p_name, ' ', '|') || '|' || p_type END AS tags FROM part")
def _(spark, d):
    tags = F.split("p_name", " ")
    category = F.when(F.col("p_size") < 10, F.element_at(tags, 1)).otherwise(F.col("p_type"))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(T.append_if_absent(tags, category), "|").alias("tags"))


def _spans(spark, d):
    spans = F.array(F.col("p_type"), F.lit("Featured"), F.when(F.col("p_size") < 25, "Full-Time").otherwise("Contract"),
                    F.when(F.col("p_size") < 10, "FREELANCE").otherwise(F.col("p_brand")),
                    F.when(F.col("p_size") > 40, "Anywhere in the World").otherwise("Europe"))
    return V.table(spark, d, "part").withColumn("spans", spans)


_TYPE = "CASE WHEN p_size < 10 THEN 'freelance' WHEN p_size < 25 THEN 'full-time' ELSE 'contract' END"
_SPAN_TAGS = """p_type || CASE WHEN p_size < 10 THEN '' ELSE '|' || p_brand END || '|' ||
 CASE WHEN p_size > 40 THEN 'Anywhere in the World' ELSE 'Europe' END"""


@query("c15_split_spans", f"SELECT p_partkey, {_TYPE} AS job_type, {_SPAN_TAGS} AS tags FROM part")
def _(spark, d):
    job_type, tags = T.split_spans(F.col("spans"))
    return _spans(spark, d).select("p_partkey", job_type.alias("job_type"), F.array_join(tags, "|").alias("tags"))


@query("c16_location_from_tags", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Oslo' WHEN p_size > 40 "
       "THEN 'Anywhere in the World' END AS location FROM part")
def _(spark, d):
    _, tags = T.split_spans(F.col("spans"))
    given = F.when(F.col("p_type") == "ECONOMY", "Oslo").otherwise("")
    return _spans(spark, d).select("p_partkey", T.location_from_tags(given, tags).alias("location"))


@query("c17_category_name", f"SELECT p_partkey, {S.title_case('p_name')} AS category FROM part")
def _(spark, d):
    path = F.concat(F.lit("/categories/remote-"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-jobs"))
    return V.table(spark, d, "part").select("p_partkey", T.category_name(path).alias("category"))


_STEM = "replace(lower(p_name), ' ', '-') || '-' || p_size || 'd-o''neil'"


@query("c18_name_from_stem", f"SELECT p_partkey, {S.title_case(f'''replace({_STEM}, '-', ' ')''')} AS name FROM part")
def _(spark, d):
    stem = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"),
                    F.lit("d-o'neil"))
    return V.table(spark, d, "part").select("p_partkey", T.name_from_stem(stem).alias("name"))


@query("c19_pick_site_url", f"WITH {S.COMPANY_BATCH} SELECT seq, coalesce(careers_url, CASE WHEN seq < 5000 THEN website "
       "ELSE 'https://' || replace(website, 'https://', '') END) AS url FROM company_batch")
def _(spark, d):
    site = F.when(F.col("seq") < 5000, F.col("website")).otherwise(F.replace("website", F.lit("https://")))
    rows = V.company_batch(spark, d)
    return rows.select("seq", U.pick_site_url(F.coalesce("careers_url", F.lit("")), site).alias("url"))


@query("c21_absolutize", f"WITH {S.ANCHORS} SELECT seq, pos, CASE WHEN href = '' OR starts_with(href, 'http') THEN href "
       "ELSE 'https://board.example.com' || href END AS url FROM anchors")
def _(spark, d):
    from .q_crawl import _anchor_rows
    return _anchor_rows(spark, d).select("seq", "pos", U.absolutize(F.col("href"), "https://board.example.com").alias("url"))


@query("c24_labelled_field", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS location, "
       "'N' || c_nationkey AS kind FROM customer")
def _(spark, d):
    text = F.concat_ws("\n", "c_name", F.lit("  "), F.lit("employment TYPE"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")),
                       F.lit("Location"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    rows = V.table(spark, d, "customer").withColumn("lines", T.stripped_lines(text))
    return rows.select("c_custkey", T.labelled_field(F.col("lines"), "Location").alias("location"),
                       T.labelled_field(F.col("lines"), "Employment Type").alias("kind"))


@query("c41_list_names", "SELECT s_suppkey, s_name AS name, 'Nation ' || s_nationkey AS description FROM supplier")
def _(spark, d):
    from joblattice.sources.directories import parse_list
    text = F.concat(F.lit("1. [Values](https://v.example.com) - heading\n2. ["), F.col("s_name"),
                    F.lit("](https://s.example.com) — Nation "), F.col("s_nationkey").cast("string"), F.lit("...\n"))
    files = V.table(spark, d, "supplier").select("s_suppkey", text.alias("text"))
    return parse_list(files, ("s_suppkey",)).select("s_suppkey", "name", "description")


@query("c42_split_title_company", "SELECT p_partkey, p_name AS title, CASE WHEN p_size < 20 THEN 'Unknown' ELSE p_brand END "
       "AS company FROM part")
def _(spark, d):
    card = F.when(F.col("p_size") < 20, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" \n "), F.col("p_brand"), F.lit("\nmore")))
    title, company = T.split_title_company(card)
    return V.table(spark, d, "part").select("p_partkey", title.alias("title"), company.alias("company"))


TOKENS = """array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower(regexp_replace(
 lower(title) || ' | ' || lower(company), '[\\x{80}-\\x{ff}]', '', 'g')), '[^\\p{L}\\p{N}_]', ' ', 'g'), ' +'), lambda t: t <> '')), ' ')"""


@query("c26_sorted_tokens", W + f"SELECT id, {TOKENS} AS tokens FROM listings")
def _(spark, d):
    return V.listings(spark, d).select("id", sorted_tokens(F.col("title"), F.col("company")).alias("tokens"))
