"""Views of the driver's tables in listing, crawl and company shape (Spark side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.functions import html as H
from joblattice.functions.crawl import drop_noise_links
from joblattice.functions.scoring import Profile
from joblattice.functions.text import clean_text, dedup_hash, strip
from joblattice.operators.compute import compute_once
from joblattice.sources.snapshots import read_spread

AS_OF = 1704067200           # 2024-01-01 00:00:00 UTC

# Invented vocabulary made of words that occur in the test documents.
PROFILE = Profile(
    roles=("Thanded Lead", "Eauxtion", "Heitung Ment", "An of"),
    preferred_keywords=("schung", "ciónes", "with", "heit ver"),
    operations_finance=("apache license", "avec", "para"),
    technical=("und", "que", "the", "license"),
    methodology=("haha", "entre"),
    exclude_keywords=("eauaux",),
    exclude_companies=("en src3", "DE src7", "blog.tionsh.example.com"),
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread_table(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """Scan for jobs that parse every row, spread over all cores."""
    return read_spread(spark, f"{d}/{name}.parquet", key)


def hours_after(c: Column) -> Column:
    return F.timestamp_seconds(F.lit(AS_OF) + c * 3600)


def moment(hours: int) -> Column:
    return F.timestamp_seconds(F.lit(AS_OF + hours * 3600))


def epoch(name: str, out: str | None = None) -> Column:
    return F.unix_seconds(F.col(name)).alias(out or name)


def listings(spark: SparkSession, d: str) -> DataFrame:
    return shape_listings(table(spark, d, "documents"))


def text_listings(spark: SparkSession, d: str) -> DataFrame:
    """The same rows for jobs that work through the whole texts."""
    return shape_listings(spread_table(spark, d, "documents", "doc_id"))


def shape_listings(docs: DataFrame) -> DataFrame:
    """Documents as listings: the first sentence is the title, the text the description."""
    n, lang = F.col("n_chars"), F.col("lang")
    first_line = F.substring_index("text", "\n", 1)
    title = strip(F.substring_index(first_line, ".", 1))
    shaped = docs.withColumns({"title": title, "company": F.concat_ws(" ", "lang", "source")})
    return shaped.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"),
        n.cast("string").alias("external_id"), "source", "title", "company",
        F.lit(None).cast("string").alias("company_url"), F.col("text").alias("description"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/jobs/"),
                 F.left(F.md5(F.col("title")), F.lit(12))).alias("url"),
        F.when(lang == "en", F.when(n < 2000, "Remote").otherwise("Anywhere"))
        .when(lang == "de", "Berlin").when(lang == "fr", "Remote (EU)")
        .when(n >= 1500, "").alias("location"),
        F.when(n >= 3000, n * 10).when(n >= 1500, 0).alias("salary_min"),
        F.when(n >= 1000, n * 15).when(n >= 500, 0).alias("salary_max"),
        F.lit("USD").alias("salary_currency"),
        F.array(lang, F.col("source"), F.concat(F.lit(" "), F.upper(lang), F.lit(" ")),
                F.when(n > 2000, "Long Form").otherwise("brief")).alias("tags"),
        F.when(lang == "en", "Full_Time").when(lang == "de", "freelance")
        .when(lang == "fr", "").alias("job_type"),
        F.lit(None).cast("string").alias("experience_level"),
        F.lit(None).cast("string").alias("date_posted"),
        hours_after(F.col("doc_id")).alias("date_scraped"),
        (n >= 600).alias("is_active"),
        dedup_hash(F.col("title"), F.col("company")).alias("dedup_hash"),
        F.lit(None).cast("string").alias("raw_data"))


def known_listings(spark: SparkSession, d: str) -> DataFrame:
    """The stored side of merges: listings whose document carries a label."""
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return listings(spark, d).join(labelled, "id", "left_semi")


def _located(p: DataFrame) -> DataFrame:
    """Add the number and the host of the url."""
    return compute_once(p, {"num": F.regexp_extract("url", r"/(\d+)", 1).cast("bigint"),
                            "company": F.regexp_extract("url", r"^https?://([^/]+)", 1)})


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as fetched sites; frames, board links and noise links are added by url number."""
    p = _located(spread_table(spark, d, "pages", "page_id"))
    n, text = F.col("num"), F.col("num").cast("string")

    def cat(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    block = (F.when(n < 250, cat('<iframe src="//boards.greenhouse.io/embed/job_board?for=s',
                                 text, '"></iframe>'))
             .when(n < 350, cat('<a href="https://jobs.lever.co/site/', text, '">Board</a>'))
             .when(n < 450, F.lit('<a href="/team">View our <b>roles</b></a>'))
             .when(n < 550, F.lit('<a href="careers/open?x=1">Work</a>'))
             .when(n < 800, cat('<a href="/jobs/', text, '">Data Engineer ', text, "</a>"))
             .otherwise(F.lit("")))
    noise = ('<a href="https://twitter.com/site">Follow us</a><a href="/privacy">Privacy policy</a>'
             '<a href="#top">Top of page</a>')
    body = F.when(n >= 900, F.regexp_replace("html", r"(?s)<article>.*</article>", "")).otherwise(
        F.col("html"))
    status = (F.when(n < 40, 404).when(n < 70, 403).when(n < 90, 401).when(n < 130, 503)
              .when(n >= 160, 200))
    return p.select(
        F.col("page_id").alias("seq"), "num", "company", F.col("url").alias("careers_url"),
        F.col("url").alias("final_url"), status.cast("bigint").alias("status"),
        F.replace(body, F.lit("</body>"), F.concat(block, F.lit(noise + "</body>"))).alias("html"))


def _error(n: Column, url: Column) -> Column:
    return (F.when(n < 40, "http_404 page not found").when(n < 70, "http_403 forbidden")
            .when(n < 90, "http_401 unauthorized").when(n < 130, "http_503 server error")
            .when(n < 160, F.concat(F.lit("net::ERR_NAME_NOT_RESOLVED at "), url))
            .when(n < 180, "net::ERR_CONNECTION_REFUSED").when(n < 200, "SSL handshake failed")
            .when(n < 215, "net::ERR_TOO_MANY_REDIRECTS").when(n < 235, "total timeout exceeded")
            .when(n < 250, "Timeout 25000ms exceeded").when(n < 265, "net::ERR_ABORTED")
            .when(n < 290, "insufficient_content").when(n < 300, "strange failure"))


def crawl_log(spark: SparkSession, d: str) -> DataFrame:
    """Crawl records of all pages; low url numbers fail, high ones carry no text."""
    p = pages(spark, d)
    n = F.col("num")
    error = _error(n, F.col("careers_url"))
    text = F.when(error.isNull() & (n < 980), clean_text(H.visible_text(F.col("html"))))
    links = drop_noise_links(H.page_links(H.anchors(F.col("html")), F.col("final_url")))
    none = F.array().cast("array<struct<text:string,href:string>>")
    return compute_once(p, {
        "error": error, "text": text,
        "links": F.when(error.isNull() & (n < 950), links).otherwise(none)}).drop("html", "status")


def error_log(spark: SparkSession, d: str) -> DataFrame:
    """Crawl records without links, for diagnostics (reads the url column only)."""
    p = _located(table(spark, d, "pages")).select(
        F.col("page_id").alias("seq"), "num", "company", F.col("url").alias("careers_url"))
    n = F.col("num")
    error = _error(n, F.col("careers_url"))
    return p.select("seq", "num", "company", "careers_url", error.alias("error"),
                    F.when(error.isNull() & (n < 980), "page text").alias("text"))


def recrawl(spark: SparkSession, d: str) -> DataFrame:
    """A later crawl of all pages: some recovered, some lost."""
    n = F.col("num")
    error = (F.when(n < 150, None).when(n > 950, "late failure").otherwise(F.col("error")))
    return (error_log(spark, d).withColumn("error", error.cast("string"))
            .withColumn("text", F.when(F.col("error").isNull(), "fresh text")))


def recrawl_records(records: DataFrame) -> DataFrame:
    """A later crawl of the same records, with new texts and links."""
    n = F.col("num")
    error = F.when(n < 150, None).when(n > 950, "late failure").otherwise(F.col("error"))
    link = F.array(F.struct(F.lit("Open roles").alias("text"), F.col("careers_url").alias("href")))
    return (records.withColumn("error", error.cast("string"))
            .withColumn("text", F.when(F.col("error").isNull(),
                                       F.concat(F.lit("fresh "), F.coalesce("text", F.lit("")))))
            .withColumn("links", F.when(n < 150, link).otherwise(F.col("links"))))


def link_lines(links: Column) -> Column:
    """Links as lines of text and address."""
    return F.array_join(F.transform(links, lambda x: F.concat(x["text"], F.lit("|"), x["href"])), "\n")


def companies(spark: SparkSession, d: str) -> DataFrame:
    """Customers as company directory."""
    seg = F.col("c_mktsegment")
    policy = (F.when(seg == "BUILDING", "fully-remote").when(seg == "MACHINERY", "remote-first")
              .when(seg == "FURNITURE", "hybrid"))
    return table(spark, d, "customer").select(
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"),
                                                F.lit(".example.com"))).alias("website"),
        F.lit(None).cast("string").alias("careers_url"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("c_acctbal") > 5000, "51-200").alias("size"), policy.alias("remote_policy"),
        F.array(F.lower(seg), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
        .alias("tech_stack"), F.lit("customers").alias("source"))


def company_batch(spark: SparkSession, d: str) -> DataFrame:
    """Orders as company updates in arrival order, with many missing values."""
    o = table(spark, d, "orders")
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"),
        F.when(status == "P", F.concat(F.lit("https://o"), F.col("o_orderkey").cast("string")))
        .alias("website"),
        F.when(prio == "1-URGENT", F.concat(F.lit("https://jobs/"), F.col("o_orderkey").cast("string")))
        .alias("careers_url"),
        F.when(status == "F", prio).alias("description"),
        F.when(F.col("o_totalprice") > 400000, "1000+").alias("size"),
        F.when(prio == "5-LOW", "hybrid").alias("remote_policy"),
        F.when(status == "O", F.array(F.lower(prio))).otherwise(F.array().cast("array<string>"))
        .alias("tech_stack"),
        F.when(prio != "3-MEDIUM", F.concat(F.lit("orders-"), status)).alias("source"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as finished run rows."""
    e = table(spark, d, "events")
    found = F.floor("value").cast("bigint")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"),
        F.col("ts").alias("started_at"), found.alias("jobs_found"),
        F.floor(found / 2).cast("bigint").alias("jobs_new"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
