"""Incremental ingest: every micro-batch is merged as if rows arrived one by one.

Listings are append-only on disk: a batch adds its new rows and its sightings,
never rewriting the store. Of the store and of earlier batches it reads key
filters and the parts of the key table its own keys may be in. Tables are partitioned by stream (a digest of its checkpoint) and batch
id; a batch that is replayed after a failure reads all but itself and what
followed it in its stream and replaces its own folders, so the result does not
depend on retries, and a new checkpoint on the same root replaces nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.companies import upsert_companies
from ..operators.merge import refresh, resolve_batch
from ..sources.key_store import PARTS, KeyStore

#: Company records that one task of the merge sorts.
TASK_ROWS = 500_000

_SIGHTINGS = T.StructType([T.StructField("key", T.StringType()),
                           T.StructField("last_seen", T.TimestampType())])


def _stream_id(checkpoint: str) -> str:
    """Name of a stream's folders; a digest of its checkpoint, which is the stream's identity."""
    return "s" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _folder(root: str, table: str, stream: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/{table}/stream={stream}/batch_id={batch_id}"


def _read(spark: SparkSession, root: str, table: str, schema: T.StructType,
          before: tuple[str, int] | None = None) -> DataFrame:
    """Rows of all batches, or of all but a stream's batches from one on (partition pruning)."""
    with_batch = T.StructType([*schema.fields, T.StructField("stream", T.StringType()),
                               T.StructField("batch_id", T.LongType())])
    try:
        rows = spark.read.schema(with_batch).parquet(f"{root.rstrip('/')}/{table}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], with_batch)
    if before is None:
        return rows
    stream, batch_id = before
    return rows.where((F.col("stream") != stream) | (F.col("batch_id") < batch_id))


def _start(stream: DataFrame, checkpoint: str, handle) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_listings(stream: DataFrame, root: str, checkpoint: str, base: DataFrame,
                    parts: int = PARTS) -> StreamingQuery:
    """Merge a stream of listings (with ``seq``) onto ``base``; ends when the input is read.

    The keys of ``base`` are laid out below ``root`` when its first stream starts.
    """
    mine = _stream_id(checkpoint)
    KeyStore(base.sparkSession, f"{root.rstrip('/')}/keys", parts).ensure_base(base)

    def handle(batch: DataFrame, batch_id: int) -> None:
        store = KeyStore(batch.sparkSession, f"{root.rstrip('/')}/keys", parts)
        done = resolve_batch(store.lookup(batch, before=(mine, batch_id)), batch)
        added = _folder(root, "listings", mine, batch_id)
        done.inserted().select(*base.columns).write.mode("overwrite").parquet(added)
        done.seen.write.mode("overwrite").parquet(_folder(root, "sightings", mine, batch_id))
        store.append(batch.sparkSession.read.schema(base.schema).parquet(added), mine, batch_id)

    return _start(stream, checkpoint, handle)


def current_listings(spark: SparkSession, root: str, base: DataFrame) -> DataFrame:
    """Listings after all batches. Write the result as the next base to compact the store."""
    added = _read(spark, root, "listings", base.schema).drop("stream", "batch_id")
    # The last sighting of each stream; of several streams the latest time.
    last = (_read(spark, root, "sightings", _SIGHTINGS).groupBy("key", "stream")
            .agg(F.max_by("last_seen", "batch_id").alias("last_seen"))
            .groupBy("key").agg(F.max("last_seen").alias("last_seen")))
    return refresh(base.unionByName(added), last)


def ingest_companies(stream: DataFrame, root: str, checkpoint: str, base: DataFrame,
                     seq: str = "seq") -> StreamingQuery:
    """Merge a stream of company records onto ``base``.

    A batch adds its rows as they are; ``seq`` increases over the whole stream.
    """
    columns, mine = [*base.columns, seq], _stream_id(checkpoint)

    def handle(batch: DataFrame, batch_id: int) -> None:
        (batch.select(*columns).write.mode("overwrite")
         .parquet(_folder(root, "companies", mine, batch_id)))

    return _start(stream, checkpoint, handle)


def current_companies(spark: SparkSession, root: str, base: DataFrame, seq: str = "seq",
                      task_rows: int = TASK_ROWS) -> DataFrame:
    """Companies after all batches."""
    schema = T.StructType([*base.schema.fields, T.StructField(seq, T.LongType())])
    rows = _read(spark, root, "companies", schema).select(*base.columns, seq)
    # The merge sorts what a task reads, and packed files hold many rows: dealt out by row.
    tasks = -(-rows.count() // task_rows)
    if tasks > rows.rdd.getNumPartitions():
        rows = rows.repartition(tasks, "name", seq)
    return upsert_companies(base, rows, seq)
