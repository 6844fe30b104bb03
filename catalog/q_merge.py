"""Upserts, run log, duplicates and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblattice.functions.text import dedup_hash
from joblattice.operators import companies as C
from joblattice.operators import dedup as DD
from joblattice.operators import merge as M
from joblattice.operators import ranking as R
from joblattice.plans import jobs as J

from . import sql as S
from . import views as V
from .q_scalars import TOKENS
from .registry import query

# The batch is the whole listings view seen again 3000 hours later.
LATER = 3000


def listing_batch(spark, d):
    rows = V.listings(spark, d)
    return rows.withColumn("date_scraped", V.hours_after(F.col("id") + LATER))


# Row-at-a-time upsert: the lists hold the hashes and (source, external_id) keys taken so far.
_SEQUENTIAL = """b AS (SELECT row_number() OVER (ORDER BY seq) AS n, * FROM listings),
 step AS (SELECT CAST(0 AS BIGINT) AS n, {hashes} AS hashes, {keys} AS keys, CAST(NULL AS VARCHAR) AS label
  UNION ALL
  SELECT n, CASE WHEN label = 'insert' THEN list_append(hashes, dedup_hash) ELSE hashes END,
    CASE WHEN label = 'insert' THEN list_append(keys, k) ELSE keys END, label
  FROM (SELECT b.n, s.hashes, s.keys, b.dedup_hash, b.source || '|' || b.external_id AS k,
    CASE WHEN list_contains(s.hashes, b.dedup_hash) THEN 'touch'
      WHEN list_contains(s.keys, b.source || '|' || b.external_id) THEN 'ignored' ELSE 'insert' END AS label
    FROM step s JOIN b ON b.n = s.n + 1)),
 labels_ AS (SELECT b.*, s.label FROM step s JOIN b ON b.n = s.n)"""
_ONTO_KNOWN = _SEQUENTIAL.format(
    hashes="(SELECT list(dedup_hash) FROM known)", keys="(SELECT list(source || '|' || external_id) FROM known)")
_ONTO_NOTHING = _SEQUENTIAL.format(hashes="CAST([] AS VARCHAR[])", keys="CAST([] AS VARCHAR[])")
_WR = f"WITH RECURSIVE {S.LISTINGS}, {S.KNOWN}, "


def _snapshot(stored: str, later: int) -> str:
    return f"""SELECT k.id, k.source, k.title, k.dedup_hash, coalesce(t.last_seen, k.scraped) AS date_scraped,
   t.last_seen IS NOT NULL OR k.is_active AS is_active
 FROM (SELECT id, source, title, dedup_hash, scraped, is_active FROM {stored}
   UNION ALL SELECT id, source, title, dedup_hash, NULL, true FROM labels_ WHERE label = 'insert') k
 LEFT JOIN (SELECT dedup_hash, arg_max(scraped + {later} * 3600, seq) AS last_seen FROM labels_
   WHERE label <> 'ignored' GROUP BY dedup_hash) t ON k.dedup_hash = t.dedup_hash"""


def _shape(snapshot):
    return snapshot.select("id", "source", "title", "dedup_hash", V.epoch("date_scraped"), "is_active")


@query("j1_upsert_listings", _WR + _ONTO_KNOWN + _snapshot("known", LATER))
def _(spark, d):
    return _shape(M.upsert_listings(V.known_listings(spark, d), listing_batch(spark, d)).snapshot)


@query("j1_upsert_labels", _WR + _ONTO_KNOWN + " SELECT seq, label FROM labels_")
def _(spark, d):
    result = M.upsert_listings(V.known_listings(spark, d), listing_batch(spark, d))
    return result.labels.select("seq", "label")


_COUNTS = """SELECT source, count(*) AS jobs_found, count(*) FILTER (WHERE label = 'insert') AS inserted,
 count(*) FILTER (WHERE label = 'touch') AS touched, count(*) FILTER (WHERE label = 'ignored') AS ignored,
 count(*) FILTER (WHERE label <> 'touch') AS jobs_new FROM labels_ GROUP BY source"""


@query("a7_run_counts", _WR + _ONTO_KNOWN + " " + _COUNTS)
def _(spark, d):
    return M.upsert_listings(V.known_listings(spark, d), listing_batch(spark, d)).counts()


def _in_slices(spark, d, rows, order: str, slices: int = 3):
    """Streams over one folder, each after a further slice of ``rows`` by ``order`` has arrived.

    A slice is as many files as tasks wrote it; a stream with the checkpoint of the one before
    reads only what is new.
    """
    from joblattice.session import new_folder
    path = new_folder(spark, "arrivals")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // slices + 1
    for n in range(slices):
        start = (low or 0) + n * step
        part = rows.where((F.col(order) >= start) & (F.col(order) < start + step))
        part.write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


@query("t1_incremental_ingest", _WR + _ONTO_KNOWN + _snapshot("known", LATER))
def _(spark, d):
    from joblattice.session import new_folder
    from joblattice.streaming import incremental as I
    root = new_folder(spark, "stream")
    stored = V.known_listings(spark, d).drop("seq")
    for stream in _in_slices(spark, d, listing_batch(spark, d), "seq"):
        I.ingest_listings(stream, root + "/store", root + "/log", stored,
                          parts=16).awaitTermination()
    return _shape(I.current_listings(spark, root + "/store", stored))


_COMPANY_COLS = ("website", "careers_url", "description", "size", "remote_policy", "source")
_MERGED = f"""WITH {S.COMPANIES}, {S.COMPANY_BATCH}, rows_ AS (SELECT -1 AS seq, name, website, careers_url, description,
   size, remote_policy, tech_stack, source FROM companies
   UNION ALL SELECT seq, name, website, careers_url, description, size, remote_policy, tech_stack, source FROM company_batch)
 SELECT name, array_to_string(arg_max(tech_stack, seq), ',') AS tech, """ + ", ".join(
     f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _COMPANY_COLS) + " FROM rows_ GROUP BY name"


@query("j2_upsert_companies", _MERGED)
def _(spark, d):
    merged = C.upsert_companies(V.companies(spark, d), V.company_batch(spark, d))
    return merged.select("name", F.array_join("tech_stack", ",").alias("tech"), *_COMPANY_COLS)


@query("t1_company_ingest", _MERGED)
def _(spark, d):
    from joblattice.session import new_folder
    from joblattice.streaming import incremental as I
    root = new_folder(spark, "stream")
    stored = V.companies(spark, d)
    for stream in _in_slices(spark, d, V.company_batch(spark, d), "seq"):
        I.ingest_companies(stream, root + "/store", root + "/log", stored).awaitTermination()
    merged = I.current_companies(spark, root + "/store", stored)
    return merged.select("name", F.array_join("tech_stack", ",").alias("tech"), *_COMPANY_COLS)


@query("w5_latest_values", f"WITH {S.COMPANY_BATCH} SELECT name, " + ", ".join(
    f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _COMPANY_COLS)
    + " FROM company_batch GROUP BY name")
def _(spark, d):
    return C.latest_values(V.company_batch(spark, d), "name", "seq", _COMPANY_COLS)


_RUNS = """SELECT event_id AS id, event_type AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at,
 CASE WHEN event_type <> 'view' THEN strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') END AS finished_at,
 CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS jobs_found,
 CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE CAST(floor(value / 2) AS BIGINT) END AS jobs_new,
 CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN event_type = 'error' THEN props END AS error_message FROM events"""


@query("j3_run_log", _RUNS)
def _(spark, d):
    e = V.table(spark, d, "events")
    kind, failed = F.col("event_type"), F.col("event_type") == "error"
    starts = e.select(F.col("event_id").alias("id"), kind.alias("source"), F.col("ts").alias("started_at"))
    zero = F.lit(0).cast("bigint")
    finishes = e.where(kind != "view").select(
        F.col("event_id").alias("id"), (F.col("ts") + F.expr("interval 90 seconds")).alias("finished_at"),
        F.when(failed, zero).otherwise(F.floor("value")).alias("jobs_found"),
        F.when(failed, zero).otherwise(F.floor(F.col("value") / 2)).alias("jobs_new"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.col("props")).alias("error_message"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return M.run_log(starts, finishes).withColumns({
        c: F.date_format(c, stamp) for c in ("started_at", "finished_at")})


@query("w1_first_per_url", f"WITH {S.LISTINGS} SELECT id, url FROM listings "
       "QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1")
def _(spark, d):
    return R.keep_first(V.listings(spark, d).select("id", "seq", "url"), ["url"], F.col("seq")).select("id", "url")


# --- duplicates ---------------------------------------------------------------------------

# The batch: all listings again, with words added to English and German titles.
_BATCH = """batch AS (SELECT id, source, company, CASE split_part(company, ' ', 1) WHEN 'en' THEN title || ' ii'
  WHEN 'de' THEN 'Neu ' || title ELSE title END AS title FROM listings)"""
_HASH = f"substr(sha256({S.strip('lower(title)')} || '|' || {S.strip('lower(company)')}), 1, 16)"


def retitled(spark, d):
    rows = V.text_listings(spark, d)
    lang = F.element_at("tags", 1)
    title = (F.when(lang == "en", F.concat("title", F.lit(" ii")))
             .when(lang == "de", F.concat(F.lit("Neu "), F.col("title"))).otherwise(F.col("title")))
    return (rows.withColumn("title", title)
            .withColumn("dedup_hash", dedup_hash(F.col("title"), F.col("company"))))


_DW = f"WITH {S.LISTINGS}, {S.KNOWN}, {_BATCH}, "
_EXACT = f"tagged AS (SELECT *, {_HASH} IN (SELECT dedup_hash FROM known) AS exact FROM batch)"


@query("j4_exact_duplicates", _DW + _EXACT + " SELECT id, title, exact FROM tagged")
def _(spark, d):
    batch, known = retitled(spark, d), V.known_listings(spark, d)
    return (DD.exact_duplicates(batch, known).select("id", "title", F.lit(True).alias("exact"))
            .unionByName(DD.not_exact_duplicates(batch, known).select("id", "title", F.lit(False).alias("exact"))))


# All (new, stored) text pairs of matching companies, trimmed of their common ends, and the
# longest common subsequence of what remains as a row-by-row dynamic program.
_PAIRS = f"""n AS (SELECT DISTINCT {TOKENS} AS a, lower(substr(company, 1, 20)) AS key FROM batch),
 o AS (SELECT DISTINCT {TOKENS} AS b, lower(company) AS b_company FROM known WHERE is_active),
 p AS (SELECT *, length(a) + length(b) AS total FROM n JOIN o ON contains(b_company, key)),
 near AS (SELECT *, string_split(a, '') AS x, string_split(b, '') AS y FROM p
   WHERE abs(length(a) - length(b)) * 200 < 31 * total AND levenshtein(a, b) * 200 < 31 * total),
 head AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i]), true)
   - 1, least(len(x), len(y))) AS h FROM near),
 tail AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) - h + 1),
   lambda i: x[len(x) - i + 1] <> y[len(y) - i + 1]), true) - 1, least(len(x), len(y)) - h) AS t FROM head),
 core AS (SELECT *, x[h + 1:len(x) - t] AS u, y[h + 1:len(y) - t] AS v FROM tail),
 lcs AS (SELECT *, h + t + CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0 ELSE list_last(list_reduce(
   list_transform(v, lambda c: list_transform(u, lambda e: CAST(e = c AS BIGINT))),
   lambda r, m: list_transform([list_transform(range(1, len(m) + 1), lambda i:
       CASE WHEN m[i] = 1 THEN coalesce(r[i - 1], 0) + 1 ELSE r[i] END)],
     lambda w: list_transform(range(1, len(w) + 1), lambda i: list_max(w[1:i])))[1],
   list_transform(u, lambda e: CAST(0 AS BIGINT)))) END AS common FROM core),
 scored AS (SELECT a, key, b, b_company, total, total - 2 * common AS indel FROM lcs),
 fuzzy AS (SELECT *, CAST(round_even(100.0 * (1.0 - indel / total), 0) AS BIGINT) AS similarity FROM scored
   WHERE indel * 200 < 31 * total)"""


@query("j5_fuzzy_matches", _DW + _PAIRS + " SELECT a, key, b, b_company, similarity FROM fuzzy")
def _(spark, d):
    return DD.fuzzy_matches(retitled(spark, d), V.known_listings(spark, d))


@query("c26_similarity", _DW + _PAIRS + " SELECT DISTINCT a, b, similarity FROM fuzzy WHERE a <> b")
def _(spark, d):
    pairs = DD.fuzzy_matches(retitled(spark, d), V.known_listings(spark, d))
    return pairs.where("a <> b").select("a", "b", "similarity").distinct()


_KIND = (_EXACT + ", " + _PAIRS + f""", kinds AS (SELECT t.id, t.title, CASE WHEN exact THEN 'exact' WHEN EXISTS (
   SELECT 1 FROM fuzzy f WHERE f.a = {TOKENS.replace('title', 't.title').replace('company', 't.company')}
     AND f.key = lower(substr(t.company, 1, 20))) THEN 'fuzzy' END AS dup_kind FROM tagged t)""")


@query("j6_split_batch", _DW + _KIND + " SELECT id, title, dup_kind FROM kinds")
def _(spark, d):
    return DD.tag_duplicates(retitled(spark, d), V.known_listings(spark, d)).select("id", "title", "dup_kind")


@query("a9_dedup_totals", _DW + _KIND + " SELECT coalesce(dup_kind, 'unique') AS dup_kind, count(*) AS cnt FROM kinds GROUP BY 1")
def _(spark, d):
    return DD.dedup_totals(DD.tag_duplicates(retitled(spark, d), V.known_listings(spark, d)))


@query("p9_split_duplicates", _DW + _KIND + " SELECT id, title, dup_kind IS NOT NULL AS duplicate FROM kinds")
def _(spark, d):
    unique, duplicate, _ = J.split_duplicates(retitled(spark, d), V.known_listings(spark, d))
    return (unique.select("id", "title", F.lit(False).alias("duplicate"))
            .unionByName(duplicate.select("id", "title", F.lit(True).alias("duplicate"))))
