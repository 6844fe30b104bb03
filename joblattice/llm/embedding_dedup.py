"""Near-equal embeddings: p-stable Euclidean hashing in several tables, exact cosine after.

Unit vectors with cosine s lie sqrt(2 - 2s) apart. A table quantises K Gaussian projections
with one width; K grows with the logarithm of the row count so that a vector meets about
``MET`` unrelated ones in a table, and the number of tables follows from K so that a pair at
the threshold is missed by all tables with probability ``MISS`` at most.

Rows of a bucket are dealt to chunks of about ``CHUNK`` rows and compared by pairs of chunks,
so no task holds a large bucket whole. Links are counted where the two rows meet in their
first common table; per chunk pair at most one row a vector leaves the task, never pairs.

Defined cases: null, zero, null-holding or non-finite vectors and vectors of different
length link with nothing; equal rows link like any others; a null id is a row of its own; an
empty table gives no rows; labels and further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import components, map_batches, mix, prepare, spread
from joblattice.session import cut_lineage

#: Width of a projection cell, unrelated rows met in a table, chance to miss a pair.
WIDTH = 2.0
MET = 512
MISS = 0.002

#: Rows of a bucket compared at once.
CHUNK = 1_024


def cell_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at ``distance`` share the cell of one projection."""
    r = width / distance
    return (math.erf(r / math.sqrt(2))
            - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2)))


def table_plan(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(projections a table, tables) for so many rows."""
    near, far = cell_chance(math.sqrt(2 - 2 * threshold)), cell_chance(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(rows, 1) / MET) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-near ** k)))


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Indexes of usable rows by vector length, as unit vectors in double precision."""
    usable: dict[int, list[int]] = {}
    vectors: dict[int, list[np.ndarray]] = {}
    for i, values in enumerate(column):
        if not values.is_valid or values.values.null_count or not len(values.values):
            continue
        v = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max() if np.isfinite(v).all() else 0.0
        if top > 0:
            v = v / top
            usable.setdefault(len(v), []).append(i)
            vectors.setdefault(len(v), []).append(v / np.sqrt(v @ v))
    return usable, {d: np.stack(v) for d, v in vectors.items()}


def signatures(unit: np.ndarray, k: int, tables: int, seed: int = 11) -> np.ndarray:
    """Bucket number of every row in every table."""
    dim = unit.shape[1]
    rng = np.random.Generator(np.random.PCG64([seed, dim, k, tables]))
    directions = rng.standard_normal((dim, k * tables))
    shift = rng.uniform(0, WIDTH, k * tables)
    cells = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64)
    cells = cells.reshape(len(unit), tables, k).astype(np.uint64)
    out = np.full((len(unit), tables), dim, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return out.view(np.int64)


def _chunk_links(group: pa.Table, threshold: float) -> pa.Table:
    """Links between the two sides of a chunk pair that meet here first."""
    table = group.column("t")[0].as_py()
    same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    uid = group.column("uid").to_numpy()
    n = len(uid)
    unit = pc.list_flatten(group.column("unit")).to_numpy().reshape(n, -1)
    sig = pc.list_flatten(group.column("sig")).to_numpy().reshape(n, -1)[:, :table]
    side = group.column("side").to_numpy()
    a, b = (np.arange(n),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links = np.zeros(n, dtype=np.int64)
    root = uid.copy()
    near_blocks = []
    fresh_any = False
    step = 128
    for low in range(0, len(a), step):
        rows = a[low:low + step]
        near = unit[rows] @ unit[b].T >= threshold
        if same:
            near[np.arange(len(rows)), rows] = False
        if not near.any():
            continue
        near_blocks.append((rows, near))
        fresh = near.copy()
        for t in range(table):
            fresh &= sig[rows, t][:, None] != sig[b, t][None, :]
        if fresh.any():
            fresh_any = True
            links[rows] += fresh.sum(axis=1)
            if not same:
                links[b] += fresh.sum(axis=0)
    if not fresh_any:
        return _LINKS.empty_table()
    while True:                                    # smallest uid reached inside this pair
        was = root.copy()
        for rows, near in near_blocks:
            big = np.iinfo(np.int64).max
            root[rows] = np.minimum(root[rows], np.where(near, root[b], big).min(axis=1))
            root[b] = np.minimum(root[b], np.where(near, root[rows][:, None], big).min(axis=0))
        if (was == root).all():
            break
    linked = np.zeros(n, dtype=bool)
    for rows, near in near_blocks:
        linked[rows] |= near.any(axis=1)
        linked[b] |= near.any(axis=0)
    return pa.table([uid[linked], links[linked], root[linked]], schema=_LINKS)


_LINKS = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = 0.9, miss: float = MISS) -> DataFrame:
    """``_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = cut_lineage(vectors.select(F.monotonically_increasing_id().alias("uid"),
                                      F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")))
    k, tables = table_plan(rows.count(), threshold, miss)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        uid = batch.column("uid").to_numpy()
        usable, units = _unit_rows(batch.column("_v"))
        parts = [pa.RecordBatch.from_arrays(
            [pa.array(uid[usable[d]]),
             pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), d).cast(
                 pa.list_(pa.float64())),
             pa.FixedSizeListArray.from_arrays(
                 pa.array(signatures(unit, k, tables).ravel()), tables).cast(
                     pa.list_(pa.int64()))],
            ["uid", "unit", "sig"]) for d, unit in units.items()]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    signed = cut_lineage(map_batches(spread(rows.select("uid", "_v")), sign,
                                     "uid long, unit array<double>, sig array<long>"))
    buckets = (signed.select(F.posexplode("sig").alias("t", "bucket"))
               .groupBy("t", "bucket").count().where("count > 1")
               .select("t", "bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    buckets = cut_lineage(buckets)
    placed = (signed.select("uid", "unit", "sig", F.posexplode("sig").alias("t", "bucket"))
              .join(buckets, ["t", "bucket"])
              .withColumn("c", F.pmod(F.xxhash64("uid", "t"), F.col("chunks")).cast("int"))
              .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("uid", "unit", "sig", "t", "bucket", F.least("c", "o").alias("i"),
                      F.greatest("c", "o").alias("j"),
                      F.when(F.col("c") <= F.col("o"), 0).otherwise(1).alias("side")))

    def compare(group: pa.Table) -> pa.Table:
        return _chunk_links(group, threshold)

    linked = cut_lineage(placed.groupBy("t", "bucket", "i", "j")
                         .applyInArrow(compare, "uid long, links long, root long"))
    counts = linked.groupBy("uid").agg(F.sum("links").alias("n_links"))
    roots = components(linked.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    found = cut_lineage(rows.select("uid", "_id")
                        .join(counts, "uid", "left")
                        .join(roots.withColumnRenamed("node", "uid"), "uid", "left"))
    names = found.where("root is not null").groupBy("root").agg(F.min("_id").alias("low"))
    out = found.join(names, "root", "left")
    component = F.coalesce("low", "_id")
    return out.select("_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
