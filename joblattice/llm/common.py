"""Shared pieces: batch limits, whole-table positions, word hashes, connected components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import joblattice
from joblattice.session import cut_lineage

#: Rows and bytes of one Arrow batch sent to Python, so that a task's memory is bounded
#: by one batch or by one long text.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20

#: Bytes hashed in one numpy pass.
HASH_BYTES = 2 << 20

SPACE = b"\t\n\x0b\x0c\r "


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound the session's Arrow batches and send this package to its Python workers."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(joblattice.__file__).parent
        target = Path(tempfile.mkdtemp(prefix="joblattice-")) / "joblattice.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, str(source.relative_to(package.parent)))
        sc.addPyFile(str(target))                     # Spark's file server hands it out
        _SHIPPED.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition a core: short inputs would else fill one task with Python work."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column, nulls as empty."""
    return [b"" if x is None else x for x in pc.cast(batch.column(name), pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``None`` gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out
    return df.mapInArrow(run, schema)


# --- positions over a whole table -------------------------------------------------------

def with_position(df: DataFrame, keys: list[Column], name: str = "pos") -> DataFrame:
    """Number the rows from 0 in the order of ``keys``, without a single-task window.

    Range partitions are sorted and written with (partition, place); the rows before a
    partition are a running sum over one small row a partition. The last key should be
    unique, else rows that tie are numbered in any order. ``df`` must be narrow and
    materialised: range sampling reads it twice.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
               .withColumn("_at", F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.cast("int").alias("_part")).count().collect()
    sizes = sorted((r["_part"], r["count"]) for r in sizes)      # one row a partition
    before, total = [], 0
    for number, count in sizes:
        before.append((number, total))
        total += count
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return (ordered.join(F.broadcast(offsets), part.cast("int") == F.col("_part"))
            .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_at", "_part", "_before"))


# --- word hashes ------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]                                      # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, HASH_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last byte position of every word of ``raw``; A-Z counts as a-z."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_IS_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends - 1


def words_of(texts: list[bytes], last_bytes: bool = False):
    """Word hashes of all texts in order and the number of words of each text.

    Words are runs without white space, A-Z lower-cased; the hash is 64 bits. With
    ``last_bytes`` the last byte of every word is returned as well. Long texts are cut at
    white space, so the working memory is bounded by ``HASH_BYTES`` and the result.
    """
    hashes: list[np.ndarray] = []
    lasts: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        raw = b"\n".join(texts[i] for i in group)
        h, first, last = _hash_piece(raw)
        ends = np.cumsum([len(texts[i]) + 1 for i in group])
        counts[group] += np.bincount(np.searchsorted(ends, first, side="right"),
                                     minlength=len(group))
        hashes.append(h)
        if last_bytes:
            lasts.append(np.frombuffer(raw, dtype=np.uint8)[last])
        group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > HASH_BYTES:
            flush()
            for piece in _pieces(text):
                h, _, last = _hash_piece(piece)
                hashes.append(h)
                counts[i] += len(h)
                if last_bytes:
                    lasts.append(np.frombuffer(piece, dtype=np.uint8)[last])
            continue
        if size + len(text) > HASH_BYTES:
            flush()
        group.append(i)
        size += len(text) + 1
    flush()
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    if not last_bytes:
        return all_hashes, counts
    return all_hashes, counts, (np.concatenate(lasts) if lasts else np.zeros(0, dtype=np.uint8))


def _pieces(text: bytes) -> Iterator[bytes]:
    """Cuts of a long text at white space; a longer word stays whole."""
    start = 0
    while start < len(text):
        end = start + HASH_BYTES
        if end < len(text):
            while end < len(text) and text[end] not in SPACE:
                end += 1
        yield text[start:end]
        start = end


# --- connected components ---------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node reached.

    Alternating large-star and small-star steps (Kiveris et al. 2014) over narrow edge
    rows; every step is an aggregation and a join, written to the shared folder, so a lost
    executor only repeats a step. A node with very many neighbours is aggregated before the
    shuffle and its rows are split by adaptive skew joins. No edge list reaches the driver.
    """
    spark = edges.sparkSession
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct())
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a and b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = cut_lineage(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut_lineage(large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct())
    return cut_lineage(
        edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node which hangs on none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"),
                                         F.lit(1).alias("down")))
    wrong = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        "up > 1 or (up = 1 and down = 1)")
    return wrong.limit(1).count() == 0
