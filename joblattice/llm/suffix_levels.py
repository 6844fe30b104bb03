"""Repeated passages by a family of suffix-array levels that grow geometrically.

Every string of ``length`` bytes is assigned to the smallest fingerprint of the 100-byte grams
inside it. Equal strings have equal smallest grams, so a text's suffixes need to be indexed only
where that minimum changes, about once in 150 bytes, and no repeat is lost. A level is a sampled
suffix array: entries (fingerprint of the suffix's first gram, text, place, number of strings
assigned), sorted and bucketed by fingerprint. A new batch is sorted the same way and merge-joined
with every existing level, bucket by bucket and without a shuffle of the levels; levels of
equal size are then merged into one of twice the size, like the digits of a binary counter, so
an entry is rewritten a logarithmic number of times.

The merge-scans yield candidates, on both sides: entries whose gram occurs again. Only texts
that hold candidates are read again. Their fragments meet by fingerprint and the strings inside
are compared by rolling hash and then byte by byte. Fragments of a fingerprint that fill more
than ``HOT_BYTES`` are not brought into one task: their strings are counted as 128-bit hashes,
combined before the shuffle. Equal texts are one entry; their repeats follow from their count.

Defined cases: a null text is empty; texts shorter than ``length`` cannot match; a text and its
copy remove each other whole; overlapping occurrences inside one text count; null or repeated
ids are rows of their own; very long texts are sampled in blocks; an empty table gives no rows;
only the named columns are read, so no name can clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm.common import map_batches, mix, prepare, spread, texts_of
from joblattice.operators.compute import broadcast_if_small
from joblattice.session import cut_lineage, new_folder

#: Bytes of a passage that counts as repeated, and of the gram its suffix is indexed by.
LENGTH = 400
GRAM = 100

#: Bytes sampled or compared in one numpy pass.
BLOCK = 1 << 20

#: Fragments of one fingerprint with more bytes than this are compared by counting hashes.
HOT_BYTES = 4 << 20

#: Batches the query deals the table into.
BATCHES = 4

_rng = np.random.Generator(np.random.PCG64(20250131))
_TABLES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(max(n, BLOCK + 2 * LENGTH), base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[which] = (both[0], both[1])
    return _POWERS[which]


def string_hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes that begin at every place of ``data``."""
    n = len(data)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(which, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLES[which][data] * up[:n], out=sums[1:])
    return mix((sums[length:] - sums[:n - length + 1]) * down[:n - length + 1])


def sliding(least, values: np.ndarray, width: int) -> np.ndarray:
    """``np.minimum`` or ``np.maximum`` of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = least(values[:-span], values[span:])
        span *= 2
    more = width - span
    return least(values[:-more], values[more:]) if more else values


def _twice_inside(grams: np.ndarray, least: np.ndarray, keys: np.ndarray, begins: np.ndarray,
                  counts: np.ndarray) -> np.ndarray:
    """Whether the smallest gram of a run of strings lies at several places of the run.

    Only then can two strings of one run be equal. A gram is the smallest of some string if it
    equals the largest minimum of the strings that hold it.
    """
    width = len(grams) - len(least) + 1
    edge = np.zeros(width - 1, dtype=least.dtype)
    chosen = np.flatnonzero(grams == sliding(np.maximum, np.concatenate([edge, least, edge]),
                                             width))
    names, which = np.unique(np.concatenate([keys, grams[chosen]]), return_inverse=True)
    n = len(grams) + 1
    at = np.sort(which[len(keys):] * n + chosen)
    base = which[:len(keys)] * n + begins
    return np.searchsorted(at, base + counts + width - 1) - np.searchsorted(at, base) > 1


def _inside(begins: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places at which a string of ``length`` bytes lies within one of the pieces."""
    number = np.maximum(ends - begins - length + 1, 0)
    total = int(number.sum())
    skipped = np.cumsum(number) - number
    return np.arange(total) + np.repeat(begins - skipped, number)


def _breaks(places: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of maximal runs of neighbouring places with equal values."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(places), dtype=bool)
    new[1:] = places[1:] != places[:-1] + 1
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(places))


def sample(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text index, fingerprint, place, strings, own) of the sampled suffixes of all texts.

    ``own``: strings assigned to this suffix may be equal among themselves.
    """
    found: list[tuple] = []
    group: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        places = _inside(begins, ends, length)
        if len(places):
            grams = string_hashes(data, gram)
            least = sliding(np.minimum, grams, length - gram + 1)
            first, count = _breaks(places, least[places])
            at = places[first]
            keys = least[at]
            own = _twice_inside(grams, least, keys, at, count)
            piece = np.searchsorted(ends, at, side="right")
            index = np.array([i for i, _, _ in group])[piece]
            offset = np.array([o for _, o, _ in group])[piece]
            found.append((index, keys, at - begins[piece] + offset, count, own))
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        for begin in range(0, max(len(text) - length + 1, 0), BLOCK):
            piece = text[begin:begin + BLOCK + length - 1]
            if held + len(piece) > BLOCK:
                flush()
                held = 0
            group.append((i, begin, piece))
            held += len(piece)
    flush()
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, bool))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _sample_batch(length: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "_text")
        index, keys, places, counts, own = sample(texts, length)
        offsets = pa.array(np.searchsorted(index, np.arange(len(texts) + 1)), pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, pa.array(c))
                   for c in (keys.view(np.int64), places.astype(np.int32),
                             counts.astype(np.int32), own)]
        sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        size = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("_id"), sha, size, *columns],
                                          ["_id", "_sha", "n_bytes", "keys", "places", "counts", "own"])
    return run


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            length: int = LENGTH) -> DataFrame:
    """``_id, _sha, n_bytes, keys, places, counts, own``: every row's sampled suffixes, in one pass."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    return map_batches(spread(rows), _sample_batch(length),
                       f"_id {kind}, _sha binary, n_bytes long, keys array<long>, "
                       "places array<int>, counts array<int>, own array<boolean>")


# --- levels -------------------------------------------------------------------------------

class SuffixLevels:
    """Levels of sampled suffix entries ``key, _d, place, strings, own``, bucketed and sorted by key.

    ``_d`` are the first 16 bytes of the text's SHA-256. :meth:`append` takes the sampled rows
    of a batch and returns the candidates it adds; the family keeps what later batches need.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.levels: list[tuple[int, str]] = []          # (batches held, table), newest last
        self.known: list[DataFrame] = []

    def _store(self, entries: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        (entries.repartition(self.buckets, "key").sortWithinPartitions("key")
         .write.bucketBy(self.buckets, "key").sortBy("key").format("parquet")
         .option("path", new_folder(self.spark, "suffixes")).saveAsTable(name))
        return name

    def append(self, rows: DataFrame) -> DataFrame:
        """Index a batch; candidates ``key, _d, place, strings`` of the batch and of all levels.

        Texts that an earlier batch holds are not indexed again.
        """
        texts = rows.groupBy(F.substring("_sha", 1, 16).alias("_d")).agg(
            F.first(F.struct("keys", "places", "counts", "own")).alias("s"))
        for earlier in self.known:
            texts = texts.join(earlier, "_d", "left_anti")
        texts = cut_lineage(texts)
        self.known.append(texts.select("_d"))
        entries = (texts.select("_d", F.explode(F.arrays_zip(
                       "s.keys", "s.places", "s.counts", "s.own")).alias("e"))
                   .select(F.col("e.keys").alias("key"), "_d", F.col("e.places").alias("place"),
                           F.col("e.counts").alias("strings"), F.col("e.own").alias("own")))
        name = self._store(entries)
        batch = self.spark.table(name)
        again = batch.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own"))
        found = batch.join(again.where("n > 1 or own").select("key"), "key", "left_semi")
        for _, stored in self.levels:
            level = self.spark.table(stored)
            found = (found.unionByName(batch.join(level.select("key"), "key", "left_semi"))
                     .unionByName(level.join(batch.select("key"), "key", "left_semi")))
        found = cut_lineage(found.select("key", "_d", "place", "strings"))
        self._settle(name)
        return found

    def _settle(self, name: str) -> None:
        """Add a batch as a level and merge levels while the two newest are of equal size."""
        self.levels.append((1, name))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, newer), (_, older) = self.levels.pop(), self.levels.pop()
            merged = self._store(self.spark.table(newer).unionByName(self.spark.table(older)))
            self.levels.append((2 * size, merged))
            for old in (newer, older):
                self.spark.sql(f"DROP TABLE {old}")

    def close(self) -> None:
        """Forget the tables."""
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


# --- comparison ----------------------------------------------------------------------------

def repeated_strings(pieces: list[bytes], length: int) -> np.ndarray:
    """Places in the joined pieces where a string begins that begins at another place too.

    Strings lie within a piece. They are paired by hash order and the pairs compared byte by
    byte, neighbouring pairs of one distance at once; a hash that differs in bytes is
    grouped by the bytes themselves.
    """
    raw = b"".join(pieces)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    places = _inside(ends - sizes, ends, length)
    if len(places) < 2:
        return places[:0]
    hashes = string_hashes(np.frombuffer(raw, dtype=np.uint8), length)[places]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    left, right = order[:-1][same], order[1:][same]
    repeated = np.zeros(len(places), dtype=bool)
    repeated[left] = repeated[right] = True
    by_left = np.argsort(left)
    left, right = left[by_left], right[by_left]
    x, y = places[left], places[right]
    first, count = _breaks(x, y - x)
    wrong: set[int] = set()
    for a, b, k, n in zip(x[first].tolist(), y[first].tolist(), first.tolist(), count.tolist(),
                          strict=True):
        if raw[a:a + n + length - 1] != raw[b:b + n + length - 1]:
            wrong.update(hashes[left[k:k + n]].tolist())
    for value in wrong:
        groups: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(hashes == np.uint64(value)).tolist():
            groups.setdefault(raw[places[i]:places[i] + length], []).append(i)
        for members in groups.values():
            repeated[members] = len(members) > 1
    return places[repeated]


_SPANS = pa.schema([("_d", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])


def _spans(pieces: list[tuple[bytes, int, bytes]], length: int) -> pa.RecordBatch:
    """Covered intervals of the texts the pieces (text, place, bytes) are from."""
    places = repeated_strings([p for _, _, p in pieces], length)
    sizes = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(sizes)
    first, count = _breaks(places)
    at = places[first]
    piece = np.searchsorted(ends, at, side="right")
    lo = at - (ends - sizes)[piece] + np.array([p for _, p, _ in pieces])[piece]
    return pa.RecordBatch.from_arrays(
        [pa.array([pieces[i][0] for i in piece], pa.binary()), pa.array(lo, pa.int32()),
         pa.array(lo + count - 1 + length, pa.int32())], schema=_SPANS)


def _scan(length: int):
    """Sorted fragments to covered intervals; a fingerprint's fragments are compared together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        size, key, before = 0, None, None
        for batch in batches:
            for k, d, place, raw in zip(*[batch.column(n).to_pylist() for n in (
                    "key", "_d", "place", "raw")], strict=True):
                if k != key and size > BLOCK:
                    yield _spans(held, length)
                    held, size = [], 0
                if (k, d, place) != before:                       # a row repeated with its id
                    held.append((d, place, raw))
                    size += len(raw)
                key, before = k, (k, d, place)
        if held:
            yield _spans(held, length)
    return run


def _cut(length: int):
    """Fragments of texts at their candidate suffixes."""
    schema = pa.schema([("key", pa.int64()), ("_d", pa.binary()), ("place", pa.int32()),
                        ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for text, d, found in zip(texts_of(batch, "_text"), batch.column("_d").to_pylist(),
                                      batch.column("found").to_pylist(), strict=True):
                for e in found:
                    raw = text[e["place"]:e["place"] + e["strings"] + length - 1]
                    rows.append((e["key"], d, e["place"], raw))
                    size += len(raw)
                    if size > 4 * BLOCK:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types,
                                                            strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types,
                                                    strict=True)], schema=schema)
    return run


def _hash_strings(length: int):
    """128-bit hash and place of every string of the fragments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, place, raw in zip(*[batch.column(n).to_pylist() for n in (
                    "_d", "place", "raw")], strict=True):
                for begin in range(0, len(raw) - length + 1, BLOCK):
                    data = np.frombuffer(raw[begin:begin + BLOCK + length - 1], dtype=np.uint8)
                    a, b = (string_hashes(data, length, w).view(np.int64) for w in (0, 1))
                    at = np.arange(len(a), dtype=np.int32) + place + begin
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * len(a), pa.binary()), pa.array(at), pa.array(a),
                         pa.array(b)], ["_d", "lo", "a", "b"])
    return run


def _hot_spans(fragments: DataFrame, length: int) -> DataFrame:
    """Covered intervals of fragments whose fingerprint is too common for one task."""
    strings = fragments.select("_d", "place", "raw").mapInArrow(
        _hash_strings(length), "_d binary, lo int, a long, b long")
    where = F.struct("_d", "lo")
    again = cut_lineage(strings.groupBy("a", "b").agg(
        F.min(where).alias("x"), F.max(where).alias("y")).where("x <> y").select("a", "b"))
    return (strings.join(broadcast_if_small(again), ["a", "b"], "left_semi")
            .select("_d", "lo", (F.col("lo") + length).alias("hi")))


def _kept(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Size of the merged intervals of every text and hash of what lies outside them."""
    out = []
    for d, text, spans in zip(batch.column("_d").to_pylist(), texts_of(batch, "_text"),
                              batch.column("spans").to_pylist(), strict=True):
        digest, removed, number, end = hashlib.sha256(), 0, 0, -1
        rest = 0
        for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
            if lo > end:
                digest.update(text[rest:lo])
                number, removed, end = number + 1, removed + hi - lo, hi
            elif hi > end:
                removed, end = removed + hi - end, hi
            rest = end
        digest.update(text[rest:])
        out.append((d, removed, number, digest.hexdigest()))
    schema = pa.schema([("_d", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string())])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t)
                                       for i, t in enumerate(schema.types)], schema=schema)


def resolve(docs: DataFrame, rows: DataFrame, found: DataFrame, id_col: str = "doc_id",
            text_col: str = "text", length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``_d, n_removed, n_spans, kept_sha256`` of the texts with repeated strings.

    ``rows``: the sampled rows of ``docs``; ``found``: all candidates. One row of each text
    is read for it.
    """
    found = cut_lineage(found.distinct())
    hot = cut_lineage(found.groupBy("key").agg(F.sum(F.col("strings") + length).alias("size"))
                      .where(F.col("size") > hot_bytes).select("key"))
    marked = found.join(broadcast_if_small(hot.withColumn("hot", F.lit(True))), "key", "left")
    lists = marked.groupBy("_d").agg(
        F.collect_list(F.struct("key", "place", "strings", "hot")).alias("found"))
    chosen = rows.groupBy(F.substring("_sha", 1, 16).alias("_d")).agg(F.min("_id").alias("_id"))
    wanted = cut_lineage(lists.join(chosen, "_d"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_i"), text.alias("_text"),
                        F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("_t"))
    texts = cut_lineage(
        keyed.join(wanted, (F.col("_t") == F.col("_d")) & F.col("_i").eqNullSafe(F.col("_id")))
        .select("_d", "_text", "found"))

    def fragments(is_hot: bool) -> DataFrame:
        kept = F.filter("found", lambda e: e["hot"].isNotNull() == F.lit(is_hot))
        return (texts.select("_d", "_text", kept.alias("found")).where(F.size("found") > 0)
                .mapInArrow(_cut(length), "key long, _d binary, place int, raw binary"))
    spans = (fragments(False).repartition("key").sortWithinPartitions("key", "_d", "place")
             .mapInArrow(_scan(length), "_d binary, lo int, hi int"))
    if hot.limit(1).count():
        spans = spans.unionByName(_hot_spans(fragments(True), length))
    spans = cut_lineage(spans)
    gathered = spans.groupBy("_d").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return cut_lineage(map_batches(
        texts.select("_d", "_text").join(gathered, "_d"), _kept,
        "_d binary, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["_d"]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, batches: int = BATCHES,
                   hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    The table is sampled in one pass and dealt into batches by text hash, which enter the
    levels one after another.
    """
    spark = docs.sparkSession
    rows = cut_lineage(sampled(docs, id_col, text_col, length))
    batch_no = F.pmod(F.xxhash64("_sha"), F.lit(batches))
    levels = SuffixLevels(spark)
    found = None
    for number in range(batches):
        more = levels.append(rows.where(batch_no == number))
        found = more if found is None else found.unionByName(more)
    levels.close()
    cut = resolve(docs, rows, found, id_col, text_col, length, hot_bytes)
    d = F.substring("_sha", 1, 16).alias("_d")
    copied = rows.groupBy(d).agg(F.count("*").alias("n"), F.max("n_bytes").alias("size")).where(
        F.expr(f"n > 1 and size >= {length}")).select(
        "_d", F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"))
    changed = cut_lineage(cut.join(copied.select("_d"), "_d", "left_anti").unionByName(copied))
    none = F.lit(0).cast("long")
    return (rows.select("_id", "n_bytes", d, F.lower(F.hex("_sha")).alias("_whole"))
            .join(changed, "_d", "left")
            .select("_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
                    F.coalesce("n_spans", none).alias("n_spans"),
                    F.coalesce("kept_sha256", "_whole").alias("kept_sha256")))
