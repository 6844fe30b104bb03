"""Keys of the stored listings, laid out so that a batch reads only what its keys may be in.

Both unique keys of a listing, its hash and its (source, external_id), are rows ``kind, key``.
``part`` is a prefix of the key's hash; the base is one folder a kind and part, and the keys a
batch adds are sorted by part, so that row groups are skipped by their statistics. Beside each
part lie bitmaps of the hashes in it, a few kilobytes. A batch first asks those: only keys whose
bit is set can be stored, and only the parts of such keys are read. The keys of a batch that
are new, usually most of them, cost no read of the store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compute import broadcast_if_small
from ..session import cut_lineage

#: Parts of each kind of key, and bitmaps (of 32,768 bits) beside each part. A part should
#: hold at most about 4,000 keys a bitmap, else its filter lets more unknown keys through.
PARTS = 256
BITMAPS = 8
_BITS = 1 << 15

_KEYS = "kind string, part int, key string"
_FILTERS = "kind string, part int, number int, bits binary"


def listing_keys(listings: DataFrame) -> DataFrame:
    """``kind, key`` rows of listings; missing keys have none."""
    pair = F.when(F.col("source").isNotNull() & F.col("external_id").isNotNull(), F.concat(
        F.length("source").cast("string"), F.lit(":"), F.col("source"), F.col("external_id")))
    hashed = F.when(F.col("dedup_hash") != "", F.col("dedup_hash"))
    keys = F.array(F.struct(F.lit("hash").alias("kind"), hashed.alias("key")),
                   F.struct(F.lit("pair").alias("kind"), pair.alias("key")))
    return listings.select(F.explode(keys).alias("k")).select("k.*").where("key is not null")


class KeyStore:
    """Keys below ``root``: a base, written once, and the keys of every batch since."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS,
                 bitmaps: int = BITMAPS):
        self.spark, self.root = spark, root.rstrip("/")
        self.parts, self.bitmaps = parts, bitmaps

    def _placed(self, keys: DataFrame) -> DataFrame:
        """Part, bitmap and bit of every key, all from one hash of it."""
        h = F.xxhash64("key")
        rest = F.expr(f"pmod(shiftright(xxhash64(key), 20), {self.bitmaps * _BITS})")
        return keys.withColumns({
            "part": F.pmod(h, F.lit(self.parts)).cast("int"),
            "number": (rest / _BITS).cast("int"), "bit": (rest % _BITS).cast("long")})

    def _write(self, keys: DataFrame, stream: str, batch_id: int, by_part: bool) -> None:
        placed = cut_lineage(self._placed(keys.distinct()))
        rows = placed.select("kind", "part", "key")
        where = f"stream={stream}/batch_id={batch_id}"
        if by_part:
            (rows.repartition("kind", "part").write.mode("overwrite").partitionBy("kind", "part")
             .parquet(f"{self.root}/base"))
        else:
            (rows.sortWithinPartitions("kind", "part").write.mode("overwrite")
             .parquet(f"{self.root}/added/{where}"))
        (placed.groupBy("kind", "part", "number")
         .agg(F.bitmap_construct_agg("bit").alias("bits")).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/filters/{where}"))

    def ensure_base(self, base: DataFrame) -> None:
        """Lay out the keys of the stored listings, unless that was done."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/filters/stream=base")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}/batch_id=0/_SUCCESS")
        if not files.exists(done):
            self._write(listing_keys(base), "base", 0, by_part=True)

    def append(self, listings: DataFrame, stream: str, batch_id: int) -> None:
        """Add the keys of a batch's new listings; a replayed batch replaces its own."""
        self._write(listing_keys(listings), stream, batch_id, by_part=False)

    def _read(self, table: str, schema: str, before: tuple[str, int] | None) -> DataFrame:
        batched = T._parse_datatype_string(schema + ", stream string, batch_id long")
        try:
            rows = self.spark.read.schema(batched).parquet(f"{self.root}/{table}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], batched)
        if before is None:
            return rows
        return rows.where((F.col("stream") != before[0]) | (F.col("batch_id") < before[1]))

    def possible(self, keys: DataFrame, before: tuple[str, int] | None = None) -> DataFrame:
        """The keys whose bit is set beside their part: all stored ones, few others."""
        placed = self._placed(keys)
        filters = (self._read("filters", _FILTERS, before).groupBy("kind", "part", "number")
                   .agg(F.bitmap_or_agg("bits").alias("bits")))
        byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, 1)), 16, 10)
        is_set = F.getbit(byte.cast("int"), (F.col("bit") % 8).cast("int")) == 1
        return (placed.join(filters, ["kind", "part", "number"]).where(is_set)
                .select("kind", "part", "key"))

    def lookup(self, batch: DataFrame, before: tuple[str, int] | None = None) -> DataFrame:
        """``dedup_hash, source, external_id`` of stored keys that the batch has as well.

        Enough of the store to resolve the batch. Parts to read are literals of the scan,
        so the others are pruned when files are listed; there are twice ``parts`` at most.
        """
        own = listing_keys(batch).distinct()
        wanted = cut_lineage(self.possible(own, before))
        needed = wanted.select("kind", "part").distinct().collect()        # 2 * parts at most
        where = F.lit(False)
        for kind in ("hash", "pair"):
            parts = sorted(r["part"] for r in needed if r["kind"] == kind)
            if parts:
                where = where | ((F.col("kind") == kind) & F.col("part").isin(parts))
        stored = self.stored(where, before)
        found = stored.join(broadcast_if_small(wanted), ["kind", "part", "key"], "left_semi")
        size = F.split_part("key", F.lit(":"), F.lit(1))
        tail = F.substring("key", F.length(size) + 2, F.length("key"))
        is_pair = F.col("kind") == "pair"
        return found.select(
            F.when(~is_pair, F.col("key")).alias("dedup_hash"),
            F.when(is_pair, F.left(tail, size.cast("int"))).alias("source"),
            F.when(is_pair, F.substring(tail, size.cast("int") + 1, F.length(tail)))
            .alias("external_id"))

    def stored(self, where: Column, before: tuple[str, int] | None = None) -> DataFrame:
        """Stored keys of the parts ``where`` names."""
        names = ["kind", "part", "key"]
        rows = self._read("added", _KEYS, before).where(where).select(*names)
        try:
            base = self.spark.read.schema(_KEYS).parquet(f"{self.root}/base").where(where)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return rows
        return rows.unionByName(base.select(*names))
