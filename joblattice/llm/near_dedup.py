"""Near-duplicate documents by Order MinHash, candidates verified by banded alignment.

Words are runs without white space, A-Z lower-cased; shingles are five words. A sketch value
takes the two smallest occurrence-labelled shingles under one hash function and keeps them in
text order (Marcais et al. 2019), so moved passages change it. Three sketch values make a
band, documents of one band value are candidates. Two documents are linked if the shingles
that a banded alignment matches in order are at least ``SIMILARITY`` of all their shingles
(matched / (first + second - matched)). Classes are the components of the links.

Texts of equal words are one node before any comparison. In a bucket every node is aligned
with one center. A bucket that then still holds several classes is compared by blocks of
nodes, those of one large class left out: no candidate pair between classes stays untested,
and a large class costs one comparison a node plus one block for each block of others.

Defined cases: texts without words are alone; texts of less than five words are one shingle;
a null id loses every tie; repeated rows are copies; an empty table gives no rows; further
columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import (components, map_batches, mix, prepare, spread, texts_of,
                                   words_of)
from joblattice.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
#: Sketch values a band and bands: a pair at similarity 0.8 shares no band with chance 0.001.
PER_BAND = 3
BANDS = 24
#: Nodes of a block.
CHUNK = 256
#: Bits of a fingerprint that number a place in the bitmap of nodes: 8 MB at any input size.
MAP_BITS = 26

_rng = np.random.Generator(np.random.PCG64(31))
_STEPS = _rng.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, PER_BAND * BANDS, dtype=np.uint64)
_FACTOR = (_rng.integers(1, 1 << 62, PER_BAND * BANDS, dtype=np.uint64) * np.uint64(2)
           + np.uint64(1))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes) -> bytes:
    """128 bits of the sequence of words; null bytes of it mean no words."""
    words = text.lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else bytes(16)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of every run of five words; of all words if there are fewer."""
    if not len(words):
        return words
    n = max(len(words) - SHINGLE + 1, 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(SHINGLE, len(words))):
        out += words[j:j + n] * _STEPS[j]
    return mix(out)


def _labelled(values: np.ndarray) -> np.ndarray:
    """Shingles made distinct by the number of their earlier occurrences."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    repeat = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if not repeat.any():
        return values
    at = np.arange(len(values))
    first = np.maximum.accumulate(np.where(repeat, 0, at))
    number = np.empty(len(values), dtype=np.uint64)
    number[order] = (at - first).astype(np.uint64)
    return mix(values + number * _ODD)


def sketch(values: np.ndarray) -> np.ndarray:
    """Band values of a document's shingles."""
    labelled = _labelled(values)
    n = len(values)
    out = np.empty(len(_XOR), dtype=np.uint64)
    block = max(1, (1 << 19) // n)
    for low in range(0, len(_XOR), block):
        part = slice(low, low + block)
        rank = (labelled[None, :] ^ _XOR[part, None]) * _FACTOR[part, None]
        row = np.arange(len(rank))
        first = rank.argmin(axis=1)
        if n > 1:
            rank[row, first] = np.iinfo(np.uint64).max
            second = rank.argmin(axis=1)
        else:
            second = first
        early, late = np.minimum(first, second), np.maximum(first, second)
        out[part] = mix(values[early] * _ODD + values[late])
    bands = out.reshape(BANDS, PER_BAND)
    joined = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(PER_BAND):
        joined = mix(joined * _ODD + bands[:, j])
    return joined.view(np.int64)


# --- alignment --------------------------------------------------------------------------

def _in_order_by_positions(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Longest common subsequence within the band over matching positions; None if too many."""
    places: dict[int, list[int]] = {}
    for j, v in enumerate(b.tolist()):
        places.setdefault(v, []).append(j)
    tails: list[int] = []
    work, most = 0, 20 * (len(a) + len(b)) + 1000
    for i, v in enumerate(a.tolist()):
        found = places.get(v)
        if not found:
            continue
        work += len(found)
        if work > most:
            return None
        for j in reversed(found):
            if abs(i - j) <= band:
                at = bisect_left(tails, j)
                if at == len(tails):
                    tails.append(j)
                else:
                    tails[at] = j
    return len(tails)


def _in_order_by_rows(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The same by dynamic programming, a row of the band at a time."""
    width = 2 * band + 1
    padded = np.zeros(len(b) + 2 * width, dtype=b.dtype)
    real = np.zeros(len(padded), dtype=bool)
    padded[width:width + len(b)] = b
    real[width:width + len(b)] = True
    row = np.zeros(width + 1, dtype=np.int64)                  # column j = i - band + k
    for i in range(len(a)):
        low = i - band + width
        equal = (padded[low:low + width] == a[i]) & real[low:low + width]
        best = np.maximum(row[:width] + equal, row[1:])
        row = np.concatenate([np.maximum.accumulate(best), [0]])
        row[width] = row[width - 1]
    return int(row.max())


def aligned_share(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of shingles that an alignment inside the band matches; 0 if surely below.

    At ``least`` the unmatched shingles of both sides together are at most
    (1 - least) / (1 + least) of all, which bounds how far an alignment can stray.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    if common / (n + m - common) < least:
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    rest = short - head
    differ = np.flatnonzero(a[n - rest:][::-1] != b[m - rest:][::-1]) if rest else []
    tail = int(differ[0]) if len(differ) else rest
    x, y = a[head:n - tail], b[head:m - tail]
    matched = head + tail
    if len(x) and len(y):
        band = int((n + m) * (1 - least) / (1 + least)) + 1
        found = _in_order_by_positions(x, y, band)
        matched += _in_order_by_rows(x, y, band) if found is None else found
    return matched / (n + m - matched)


# --- the job ----------------------------------------------------------------------------

def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "_text")
        words, counts = words_of(texts)
        ends = np.cumsum(counts)
        bands = [sketch(shingles(words[e - c:e])) if c else None
                 for e, c in zip(ends, counts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array([fingerprint(t) for t in texts], pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))], ["_id", "fp", "bands"])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_batches(spread(rows), run, f"_id {id_type}, fp binary, bands array<long>")


def _places(nodes: DataFrame) -> np.ndarray:
    """Bitmap, 2^MAP_BITS bits at any input size, of the places of the fingerprints of ``nodes``."""
    place = F.shiftright(F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("long"), 32 - MAP_BITS)
    bits = (nodes.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("part"))
            .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << 15) - 1)).alias("map")))
    out = np.zeros((1 << (MAP_BITS - 15), 1 << 12), dtype=np.uint8)
    for row in bits.toLocalIterator():                  # 2^11 rows of 4 kB at most
        out[row["part"]] = np.frombuffer(bytes(row["map"]), dtype=np.uint8)
    return out.ravel()


def _with_fingerprint(docs: DataFrame, text_col: str, name: str = "_fp",
                      places: np.ndarray | None = None) -> DataFrame:
    """``docs`` and the fingerprint of each text as a further column.

    With ``places`` only rows whose fingerprint has its bit set: a superset of the nodes' rows.
    """
    from pyspark.sql.types import BinaryType, StructField, StructType
    held = None if places is None else docs.sparkSession.sparkContext.broadcast(places)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t) for t in texts_of(batch, text_col)]
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.binary())],
                                         [*batch.schema.names, name])
        if held is None:
            return out
        at = np.array([int.from_bytes(x[:4], "big") for x in prints], np.int64) >> 32 - MAP_BITS
        return out.filter(pa.array((held.value[at >> 3] >> (at & 7)) & 1 == 1))
    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    return map_batches(spread(docs), run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes whose alignment reaches ``least``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, second = texts_of(batch, "ta"), texts_of(batch, "tb")
        known: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in known:
                if len(known) > 64:
                    known.clear()
                known[text] = shingles(words_of([text])[0])
            return known[text]
        ok = [aligned_share(of(x), of(y), least) >= least
              for x, y in zip(first, second, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    joined = (pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("ta")), "a")
              .join(texts.select(F.col("nid").alias("b"), F.col("text").alias("tb")), "b")
              .select("a", "b", "ta", "tb"))
    return cut_lineage(map_batches(joined, run, "a long, b long"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (bucket, nid, root) of the buckets that hold more than one class."""
    tagged = members.join(roots, F.col("nid") == F.col("node"), "left").select(
        "bucket", "nid", F.coalesce("root", "nid").alias("root"))
    mixed = tagged.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return cut_lineage(tagged.join(mixed.where("lo < hi").select("bucket"), "bucket"))


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further edges; only the graph of the roots is contracted."""
    for end in ("a", "b"):
        edges = edges.join(roots.select(F.col("node").alias(end), "root"), end, "left").withColumn(
            end, F.coalesce("root", end)).drop("root")
    over = components(edges)
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")),
                       "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut_lineage(moved.unionByName(over.join(roots.select("node"), "node", "left_anti")))


def _blocks(rest: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes of a bucket whose shingle sets are similar enough.

    A class of at least ``CHUNK`` nodes of a bucket is dealt to blocks of its own, the others
    share blocks. Every pair of blocks but those of one class is compared as a product of
    matrices, and only pairs at ``least`` leave the task. Matched shingles of an alignment are
    common shingles, so nothing that an alignment would link is lost.
    """
    large = rest.groupBy("bucket", "root").count().where(F.col("count") >= CHUNK)
    owned = rest.join(large, ["bucket", "root"], "left").select(
        "bucket", "nid", "root", F.when(F.col("count").isNull(), -1)
        .otherwise(F.col("root")).alias("g"))
    parts = owned.groupBy("bucket", "g").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = cut_lineage(owned.join(parts, ["bucket", "g"]).select(
        "bucket", "nid", "root", F.struct(
            "g", F.pmod(F.xxhash64("bucket", "nid"), F.col("parts")).alias("c")).alias("own")))
    blocks = cut_lineage(dealt.select("bucket", "own").distinct())
    sides = (blocks.withColumnRenamed("own", "i")
             .join(blocks.withColumnRenamed("own", "j"), "bucket")
             .where("i <= j and (i.g <> j.g or i.g < 0)")
             .withColumn("own", F.explode(F.array_distinct(F.array("i", "j")))))
    dealt = (sides.join(dealt, ["bucket", "own"]).join(texts, "nid")
             .select("bucket", "i", "j", "nid", "root", "text",
                     (F.col("own") == F.col("i")).alias("left"),
                     (F.col("own") == F.col("j")).alias("right")))

    def compare(group: pa.Table) -> pa.Table:
        nid, root = group.column("nid").to_numpy(), group.column("root").to_numpy()
        words, counts = words_of([t.encode() for t in group.column("text").to_pylist()])
        sets = [_labelled(shingles(words[e - c:e]))
                for e, c in zip(np.cumsum(counts), counts, strict=True)]
        x, y = (np.flatnonzero(group.column(c).to_numpy()) for c in ("left", "right"))
        size = np.array([len(v) for v in sets])
        common = common_counts([sets[k] for k in x], [sets[k] for k in y])
        share = common / (size[x][:, None] + size[y][None, :] - common)
        at, to = np.nonzero((share >= least) & (root[x][:, None] != root[y][None, :]))
        a, b = nid[x[at]], nid[y[to]]
        return pa.table([np.minimum(a, b), np.maximum(a, b)],
                        schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray],
                  columns: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, columns in slices."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    if not left or not right:
        return out
    values, place = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(v) for v in left + right])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for low in range(0, len(values), columns):
        part = slice(*np.searchsorted(place, [low, low + columns]))
        dense = np.zeros((len(left) + len(right), min(columns, len(values) - low)), np.float32)
        dense[owner[part], place[part] - low] = 1.0
        out += dense[:len(left)] @ dense[len(left):].T
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            least: float = SIMILARITY) -> DataFrame:
    """``_id, fp, class_id, class_size, kept`` of every row of ``docs``."""
    prepare(docs.sparkSession)
    rows = cut_lineage(_sketches(docs, id_col, text_col))
    nodes = cut_lineage(
        rows.where("bands is not null").groupBy("fp").agg(F.first("bands").alias("bands"))
        .withColumn("nid", F.monotonically_increasing_id()))
    spots = nodes.select("nid", F.explode("bands").alias("bucket"))
    sizes = spots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(spots.join(sizes, "bucket").select("bucket", "nid", "n"))
    # The original of a group of copies meets more of them than a copy does: it is the center.
    rank = members.groupBy("nid").agg(F.sum("n").alias("met"))
    center = members.join(rank, "nid").groupBy("bucket").agg(
        F.max(F.struct("met", "nid"))["nid"].alias("center"))
    pairs = cut_lineage(members.join(center, "bucket").where("nid <> center")
                        .select(F.least("nid", "center").alias("a"),
                                F.greatest("nid", "center").alias("b")).distinct())
    involved = cut_lineage(nodes.join(members.select("nid").distinct(), "nid", "left_semi")
                           .select("nid", "fp"))
    marked = _with_fingerprint(docs.select(F.col(text_col).alias("text")), "text", "fp",
                               _places(involved))
    texts = cut_lineage(marked.groupBy("fp").agg(F.first("text").alias("text"))
                        .join(involved, "fp").select("nid", "text"))
    edges = _verified(pairs, texts, least)
    roots = components(edges)
    rest = _mixed(members.where("n > 2"), roots)
    pairs = cut_lineage(_blocks(rest, texts, least).distinct())
    roots = _merged(roots, _verified(pairs, texts, least))
    ids = nodes.select("fp", "nid").join(roots, F.col("nid") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "nid").alias("root"))
    tagged = cut_lineage(rows.select("_id", "fp", F.col("bands").isNull().alias("blank"),
                                     F.monotonically_increasing_id().alias("row"))
                         .join(ids, "fp", "left"))
    # A row without words is a class of its own, numbered below all nodes.
    key = F.when(F.col("blank"), -F.col("row") - 1).otherwise(F.col("root"))
    tagged = tagged.withColumn("key", key)
    first = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), "row")
    heads = tagged.groupBy("key").agg(F.min(first).alias("f"), F.count("*").alias("class_size"))
    return tagged.join(heads, "key").select(
        "_id", "fp", F.col("f.id").alias("class_id"), "class_size",
        (F.col("row") == F.col("f.row")).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    found = cut_lineage(classes(docs, id_col, text_col, least))
    state = found.groupBy("_id", "fp").agg(F.max("kept").alias("any_kept"),
                                           F.count("*").alias("n"))
    gone = cut_lineage(state.where("not any_kept").select(F.col("_id").alias("_gone"),
                                                          F.col("fp").alias("_gone_fp")))
    marked = _with_fingerprint(docs, text_col)
    kept = marked.join(gone, F.col("_fp").eqNullSafe(F.col("_gone_fp"))
                       & F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")
    if state.where("any_kept and n > 1").limit(1).count():
        # Rows repeated with their id: one of them stays. Texts without words are not copies.
        blank = F.col("_fp") == F.lit(bytes(16))
        kept = kept.where(blank).unionByName(kept.where(~blank).dropDuplicates(["_fp", id_col]))
    return kept.select(*docs.columns)
