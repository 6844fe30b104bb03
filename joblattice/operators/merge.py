"""Keyed merges into the stored snapshots: listings and run log."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import compute
from .compute import is_small
from .ranking import number_rows

INSERT, TOUCH, IGNORED = "insert", "touch", "ignored"


@dataclass(frozen=True)
class UpsertResult:
    """Outcome of one batch: new snapshot and one label per batch row."""

    snapshot: DataFrame
    labels: DataFrame       # seq, source, feed if the batch has one, label

    def counts(self) -> DataFrame:
        """Totals per source; ``jobs_new`` counts ignored rows as new, as the run log does."""
        return run_counts(self.labels)


def run_counts(labels: DataFrame, by: str = "source") -> DataFrame:
    return labels.groupBy(by).agg(
        F.count(F.lit(1)).alias("jobs_found"),
        F.count_if(F.col("label") == INSERT).alias("inserted"),
        F.count_if(F.col("label") == TOUCH).alias("touched"),
        F.count_if(F.col("label") == IGNORED).alias("ignored"),
        F.count_if(F.col("label") != TOUCH).alias("jobs_new"))


def _row_key() -> Column:
    """The dedup hash; rows without one stand for themselves."""
    return F.coalesce(F.when(F.col("dedup_hash") != "", F.col("dedup_hash")),
                      F.concat(F.lit("row:"), F.col("seq").cast("string")))


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


#: Conflicting key rows that are settled by one task in arrival order.
SETTLED_ROWS = 200_000

_EXT = ["source", "external_id"]


def _accepted(candidates: DataFrame, most: int = SETTLED_ROWS) -> DataFrame:
    """``key, seq`` of rows a first-come-first-served insert would accept under both keys.

    Rows are edges between a hash and a (source, external_id); a row is accepted if no
    accepted earlier row shares an end with it. Rows that share no end, nearly all of
    them, pass at once. The others, in narrow form, are settled by one task if they are
    few; a constant number of tables is written, however long their chains are. More of
    them are first thinned out by :func:`_thin`. Ends with a NULL conflict with nothing.
    """
    rows = cut_lineage(candidates.select("seq", "key", *_EXT))          # read five times below
    twice_key = rows.groupBy("key").count().where("count > 1").select("key")
    twice_ext = (rows.dropna(subset=_EXT).groupBy(*_EXT).count().where("count > 1")
                 .select(*_EXT))
    tangled = cut_lineage(rows.join(twice_key, "key", "left_semi").select(rows.columns).unionByName(
        rows.join(twice_ext, _EXT, "left_semi").select(rows.columns)).distinct())
    free = rows.join(_hinted(tangled.select("seq"), is_small(tangled)), "seq", "left_anti")
    accepted = free.select("key", "seq")
    while not compute.is_small(tangled, rows=most):
        taken, tangled = _thin(tangled)
        accepted = accepted.unionByName(taken)
    settled = cut_lineage(tangled.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(
        _first_come(), tangled.select("key", "seq").schema))
    return accepted.unionByName(settled)


def _first_come():
    """Accepted rows among those of one table, in ``seq`` order (sent to workers by value)."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("seq")
        keys, ends = set(), set()
        taken = []
        for at, (key, source, ext) in enumerate(zip(
                *[rows.column(c).to_pylist() for c in ("key", "source", "external_id")],
                strict=True)):
            end = None if source is None or ext is None else (source, ext)
            if key not in keys and (end is None or end not in ends):
                keys.add(key)
                ends.add(end)
                taken.append(at)
        return rows.select(["key", "seq"]).take(pa.array(taken, pa.int64()))
    return run


def _drop_neighbours(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows that share no end with an accepted one."""
    return (rows.join(taken.select("key"), "key", "left_anti")
            .join(taken.select(*_EXT), _EXT, "left_anti").select(rows.columns))


def _thin(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, left over): settle what comes first at both ends, then whole chains.

    A row with one earlier neighbour is accepted exactly if that one is not. Such rows
    point to their neighbour; pointers are doubled, with the parity of the steps, until
    they end at a row without earlier neighbours, which is accepted, or at one with
    several, which is left over with all that hang on it. So a chain of any length is
    settled in a logarithmic number of joins.
    """
    first_key = rows.groupBy("key").agg(F.min("seq").alias("seq"))
    first_ext = rows.dropna(subset=_EXT).groupBy(*_EXT).agg(F.min("seq").alias("seq"))
    no_ext = rows.where(F.col("source").isNull() | F.col("external_id").isNull()).select("seq")
    winners = cut_lineage(rows.join(first_key.select("seq"), "seq", "left_semi").join(
        first_ext.select("seq").unionByName(no_ext), "seq", "left_semi").select(rows.columns))
    rest = cut_lineage(_drop_neighbours(rows, winners))

    def earlier(*end: str) -> DataFrame:
        # What is left of a group begins with its first row; only the second has one before it.
        known = rest.dropna(subset=list(end))
        order = Window.partitionBy(*end).orderBy("seq")
        return known.select("seq", F.lag("seq").over(order).alias("before"),
                            (F.row_number().over(order) - 1).alias("n"))
    both = earlier("key").unionByName(earlier(*_EXT)).groupBy("seq").agg(
        F.max("before").alias("before"), F.sum("n").alias("n"))
    chain = cut_lineage(both.select(
        "seq", F.when(F.col("n") == 1, F.col("before")).alias("to"),
        (F.col("n") == 1).alias("odd"), (F.col("n") > 1).alias("open")))
    while not chain.where("to is not null").isEmpty():
        ahead = chain.select(F.col("seq").alias("to"), F.col("to").alias("_to"),
                             F.col("odd").alias("_odd"), F.col("open").alias("_open"))
        chain = cut_lineage(chain.join(ahead, "to", "left").select(
            "seq", F.col("_to").alias("to"),
            (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
            F.when(F.col("to").isNull(), F.col("open")).otherwise(F.col("_open")).alias("open")))
    states = rest.join(chain, "seq")
    taken = cut_lineage(states.where("not open and not odd").select(rows.columns))
    open_rows = states.where("open").select(rows.columns)
    left = cut_lineage(_drop_neighbours(open_rows, taken))
    return winners.unionByName(taken).select("key", "seq"), left


@dataclass(frozen=True)
class Resolution:
    """What a batch does to a store, in key-sized tables."""

    keyed: DataFrame        # batch rows with their merge key
    labels: DataFrame       # seq, source, feed if the batch has one, label
    accepted: DataFrame     # seq of the rows to insert
    seen: DataFrame         # key, last_seen: stored or inserted keys met by the batch
    small: bool             # key tables may be broadcast

    def inserted(self) -> DataFrame:
        """New rows, dated by the last batch row that touched them."""
        rows = self.keyed.join(_hinted(self.accepted, self.small), "seq", "left_semi")
        return (rows.join(_hinted(self.seen, self.small), "key", "left")
                .withColumns({"date_scraped": F.coalesce("last_seen", "date_scraped"),
                              "is_active": F.lit(True)})
                .drop("key", "last_seen", "seq"))

    def numbered(self, after: int) -> DataFrame:
        """New rows with the ids that follow ``after``, in ``seq`` order."""
        ids = number_rows(self.accepted, "_n", F.col("seq").asc())
        keyed = (self.keyed.drop("id").join(_hinted(ids, self.small), "seq")
                 .withColumn("id", F.col("_n") + F.lit(after)).drop("_n"))
        return replace(self, keyed=keyed).inserted()


def resolve_batch(stored: DataFrame, batch: DataFrame) -> Resolution:
    """Decide insert, touch or ignore for every row of a batch (unique, increasing ``seq``).

    Only the key columns of the store are read. A row whose hash is known
    refreshes its listing; any other row is inserted unless its
    (source, external_id) is taken. The outcome equals handling the rows one by
    one in ``seq`` order. A column ``feed`` of the batch goes on into the labels.
    """
    keyed = batch.withColumn("key", _row_key())
    # Only keys and times pass through the rounds; the full rows are read once, at the end.
    feed = ["feed"] if "feed" in batch.columns else []
    narrow = cut_lineage(keyed.select("seq", "key", "source", "external_id", "date_scraped", *feed))
    groups = cut_lineage(narrow.groupBy("key", "source", "external_id")
                         .agg(F.min("seq").alias("seq")))
    # A small batch is sent to the store, so the store is scanned but never shuffled.
    small = is_small(groups)
    keys = _hinted(groups.select("key").distinct(), small)
    ids = _hinted(groups.select("source", "external_id").distinct(), small)
    known = cut_lineage(stored.where(F.col("dedup_hash") != "")
                        .select(F.col("dedup_hash").alias("key"))
                        .join(keys, "key", "left_semi").distinct())
    taken = (stored.select("source", "external_id")
             .join(ids, ["source", "external_id"], "left_semi").distinct())
    candidates = (groups.join(known, "key", "left_anti")
                  .join(taken, ["source", "external_id"], "left_anti"))
    accepted = _accepted(candidates)

    since = (known.select("key", F.lit(-1).cast("bigint").alias("since"))
             .unionByName(accepted.select("key", F.col("seq").alias("since"))))
    label = (F.when(F.col("since") == F.col("seq"), F.lit(INSERT))
             .when(F.col("since") < F.col("seq"), F.lit(TOUCH)).otherwise(F.lit(IGNORED)))
    labels = narrow.join(_hinted(since, small), "key", "left").withColumn("label", label)
    seen = cut_lineage(labels.where(F.col("label") != IGNORED).groupBy("key")
                       .agg(F.max_by("date_scraped", "seq").alias("last_seen")))
    return Resolution(keyed, labels.select("seq", "source", *feed, "label"), accepted.select("seq"),
                      seen, small)


def refresh(stored: DataFrame, seen: DataFrame, small: bool = False) -> DataFrame:
    """Stored listings with the time of their last sighting; a sighting reactivates."""
    touched = _hinted(seen.withColumnRenamed("key", "dedup_hash"), small)
    return (stored.join(touched, "dedup_hash", "left")
            .withColumns({"date_scraped": F.coalesce("last_seen", "date_scraped"),
                          "is_active": F.col("last_seen").isNotNull() | F.col("is_active")})
            .select(*stored.columns))


def upsert_listings(stored: DataFrame, batch: DataFrame) -> UpsertResult:
    """Merge a batch into the stored listings: new snapshot and row labels.

    Inserted rows of a batch without ``id`` are numbered on from the largest stored id.
    """
    done = resolve_batch(stored, batch)
    if "id" in stored.columns and "id" not in batch.columns:
        new = done.numbered(stored.agg(F.max("id")).first()[0] or 0)
    else:
        new = done.inserted()
    snapshot = refresh(stored, done.seen, done.small).unionByName(
        new, allowMissingColumns=True).select(*stored.columns)
    return UpsertResult(snapshot, done.labels)


def run_log(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Run table from appended start rows and finish rows; the last finish of a run wins."""
    end = finishes.groupBy("id").agg(F.max_by(
        F.struct("finished_at", "jobs_found", "jobs_new", "status", "error_message"),
        "finished_at").alias("end"))
    zero = F.lit(0).cast("bigint")
    return starts.join(end, "id", "left").select(
        "id", "source", "started_at", F.col("end.finished_at").alias("finished_at"),
        F.coalesce("end.jobs_found", zero).alias("jobs_found"),
        F.coalesce("end.jobs_new", zero).alias("jobs_new"),
        F.coalesce("end.status", F.lit("running")).alias("status"),
        F.col("end.error_message").alias("error_message"))
