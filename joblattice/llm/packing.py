"""Sequence packing: dominance reduction on the length histogram, best fit for the rest.

Piece lengths are whole numbers from 1 to the sequence size, so an instance is its
histogram: at most ``size`` counts, whatever the number of documents. The plan is made from
those counts on the driver; documents are tokenised, placed and numbered by Spark.

Defined cases: a null or empty text is its end token alone; copies are packed each on their
own; ties are placed in order of id and piece; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.llm import bpe
from joblattice.llm.common import map_batches, prepare, spread, texts_of, with_position
from joblattice.session import cut_lineage

#: Words whose ids a Python worker remembers, twice at most (an older generation stays).
REMEMBERED = 300_000

#: Rows of one matrix of pieces that are merged together; longer chunks go to the library.
MERGED_ROWS = 4_000
LONG_CHUNK = 32

Plan = list[tuple[int, list[int]]]            # (number of sequences, lengths in order)


# --- the plan ---------------------------------------------------------------------------

class _Lengths:
    """Counts by length with their distinct lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.sizes[bisect_right(self.sizes, length) - 1]

    def smallest(self, k: int) -> list[int]:
        """The k smallest lengths, repeated ones as often as they occur."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(self.counts[s], k - len(out))
            if len(out) == k:
                break
        return out

    def largest_to(self, room: int) -> int | None:
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None


def _copies_of(lengths: _Lengths, group: list[int]) -> int:
    """How often the group can be taken from what is left."""
    return min(lengths.counts[x] // n for x, n in Counter(group).items())


def _dominating(lengths: _Lengths, item: int, size: int) -> list[int] | None:
    """Companions of ``item`` whose set dominates every other set with it, if proven.

    ``lengths`` no longer holds the item itself. A set dominates another if the other's
    items can be split into groups that each fit in place of one of the set's own items.
    """
    room = size - item
    low = lengths.smallest(3)
    if not low or room < low[0]:
        return []                                                # nothing fits beside it
    best = lengths.largest_to(room)
    if best == room:
        return [best]                                            # fills the sequence
    if len(low) < 2 or room < low[0] + low[1]:
        return [best]                                            # one companion at most
    if len(low) == 3 and room >= sum(low):
        return None                                              # three or more would fit
    pairs = _pair_sums(lengths, room)
    if best >= int((pairs[:, 0] + pairs[:, 1]).max()):
        return [best]                                            # no pair is larger than it
    with_best = pairs[pairs[:, 1] == best]
    if not len(with_best):
        return None
    second = int(with_best[:, 0].max())
    outside = (pairs[:, 0] > second) & (pairs[:, 0] + pairs[:, 1] > best)
    return None if outside.any() else [best, second]


def _pair_sums(lengths: _Lengths, room: int) -> np.ndarray:
    """For every length the largest partner not above it with which it fits."""
    sizes = np.array([s for s in lengths.sizes if s < room], dtype=np.int64)
    rows = []
    for b in sizes:
        at = int(np.searchsorted(sizes, min(room - b, b), side="right")) - 1
        if at >= 0 and sizes[at] == b and lengths.counts[int(b)] < 2:
            at -= 1
        if at >= 0:
            rows.append((int(sizes[at]), int(b)))
    return np.array(rows or [(0, 0)], dtype=np.int64)


def reduce_by_dominance(counts: dict[int, int], size: int) -> tuple[Plan, dict[int, int]]:
    """Sets that some best packing contains, and the counts that remain.

    Lengths are taken from the largest down (Martello and Toth's reduction). A dominating
    set is fixed as often as its items allow; the proof is repeated with what is left.
    """
    lengths = _Lengths(counts)
    fixed: Plan = []
    for item in sorted(lengths.sizes, reverse=True):
        while lengths.counts.get(item):
            lengths.take(item, 1)
            companions = _dominating(lengths, item, size)
            if companions is None:
                lengths.counts[item] = lengths.counts.get(item, 0) + 1
                if item not in lengths.sizes:
                    lengths.sizes.insert(bisect_right(lengths.sizes, item), item)
                break
            lengths.counts[item] = lengths.counts.get(item, 0) + 1
            if item not in lengths.sizes:
                lengths.sizes.insert(bisect_right(lengths.sizes, item), item)
            group = [item, *companions]
            n = _copies_of(lengths, group)
            for x, k in Counter(group).items():
                lengths.take(x, n * k)
            fixed.append((n, group))
    return fixed, dict(lengths.counts)


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing on counts: equal sequences are kept as one entry with a number."""
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    open_rooms: list[int] = []

    def put(room: int, n: int, items: list[int]) -> None:
        if room not in rooms:
            rooms[room] = []
            open_rooms.insert(bisect_right(open_rooms, room), room)
        rooms[room].append((n, items))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(open_rooms, length - 1)
            if at == len(open_rooms):                            # none is open with room
                each = size // length
                n, rest = divmod(left, each)
                if n:
                    put(size - each * length, n, [length] * each)
                if rest:
                    put(size - rest * length, 1, [length] * rest)
                break
            room = open_rooms[at]
            n, items = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                del open_rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:
                put(room - each * length, full, items + [length] * each)
                n, left = n - full, left - full * each
            if n and left and left < each:
                put(room - left * length, 1, items + [length] * left)
                n, left = n - 1, 0
            if n:
                put(room, n, items)
    return [entry for groups in rooms.values() for entry in groups]


def packing_plan(counts: dict[int, int], size: int) -> Plan:
    """Sequences as (how many, lengths) for a histogram of piece lengths."""
    fixed, rest = reduce_by_dominance(counts, size)
    return fixed + best_fit(rest, size)


# --- the job ----------------------------------------------------------------------------

class _Ids:
    """Token ids of texts as little-endian 32-bit bytes, remembered by chunk.

    New chunks of a batch are merged together as rows of one matrix: each round joins the
    lowest-ranked pair (leftmost first) of every row. Long pieces and texts that hold
    special strings go through the library; both give the library's ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.rules = bpe.counter(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        symbols = self.rules.symbols
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.final = np.array([vocab[c + self.rules.end] for c in symbols], dtype=np.int64)
        pairs = [(vocab[a] << 32 | vocab[b], rank, vocab[a + b])
                 for (a, b), rank in self.rules.ranks.items()]
        pairs.sort()
        table = np.array(pairs, dtype=np.int64)
        self.keys, self.rank = table[:, 0].copy(), table[:, 1].copy()
        self.joined = np.zeros(len(pairs) + 1, dtype=np.int64)
        self.joined[self.rank] = table[:, 2]
        self.never = len(pairs)
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.rank[at], self.never)

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; rows of one matrix, padded by -1."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max()) + 1
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids = np.full((len(pieces), width), -1, dtype=np.int64)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.inner[flat]
        ends = np.cumsum(size) - 1
        ids[np.arange(len(pieces)), size - 1] = self.final[flat[ends]]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        while len(rows):
            at = np.argmin(ranks[rows], axis=1)
            low = ranks[rows, at]
            going = low < self.never
            rows, at, low = rows[going], at[going], low[going]
            if not len(rows):
                break
            mine, my_ranks = ids[rows], ranks[rows]
            behind = np.arange(1, width) > at[:, None]
            shifted = np.full_like(mine, -1)
            shifted[:, :-1] = mine[:, 1:]
            mine[:, 1:] = np.where(behind, shifted[:, 1:], mine[:, 1:])
            mine[np.arange(len(rows)), at] = self.joined[low]
            moved = np.full_like(my_ranks, self.never)
            moved[:, :-1] = my_ranks[:, 1:]
            my_ranks = np.where(np.arange(width - 1) > at[:, None], moved, my_ranks)
            here = np.arange(len(rows))
            my_ranks[here, at] = self._ranks(mine[here, at], mine[here, at + 1])
            prior = np.maximum(at - 1, 0)
            before = self._ranks(mine[here, prior], mine[here, prior + 1])
            my_ranks[here, prior] = before
            ids[rows], ranks[rows] = mine, my_ranks
        ends = np.cumsum((ids >= 0).sum(axis=1) * 4).tolist()
        raw = ids[ids >= 0].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without white space or special strings."""
        pieces: list[bytes] = []
        owner: list[int] = []
        out: list[bytes] = [b""] * len(chunks)
        for i, chunk in enumerate(chunks):
            if len(chunk) > LONG_CHUNK:
                out[i] = self._whole(chunk)
            elif chunk.isascii() and chunk.isalpha():
                pieces.append(chunk.lower().encode())
                owner.append(i)
            else:
                for piece in self.rules.pieces(chunk):
                    pieces.append(piece.encode())
                    owner.append(i)
        done: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))  # narrow matrices
        for low in range(0, len(order), MERGED_ROWS):
            part = order[low:low + MERGED_ROWS]
            for k, ids in zip(part, self.merge_rows([pieces[k] for k in part]), strict=True):
                done[k] = ids
        for i, ids in zip(owner, done, strict=True):
            out[i] += ids
        return out

    def _whole(self, text: str) -> bytes:
        found = self.library.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, dtype="<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        chunks: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if any(t in text for t in self.special):
                chunks.append(None)                              # the library splits these
                continue
            parts = (self.rules.space.split(text)
                     if any(c in text for c in bpe.PYTHON_ONLY_SPACE) else text.split())
            chunks.append(parts)
            new.update(parts)
        if len(self.seen) > REMEMBERED:                          # keep one older generation
            self.older, self.seen = self.seen, {}
        seen, older = self.seen, self.older
        new.difference_update(seen)
        words = []
        for w in new:
            if w in older:
                seen[w] = older[w]
            else:
                words.append(w)
        seen.update(zip(words, self._encode(words), strict=True))
        return [self._whole(text) if parts is None else b"".join(map(seen.__getitem__, parts))
                for text, parts in zip(texts, chunks, strict=True)]


_TOOLS: dict[str, _Ids] = {}


def _tool(name: str) -> _Ids:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark runs a task per core
    path = name if os.path.isabs(name) else bpe.vocabulary_path(name)
    if path not in _TOOLS:
        _TOOLS[path] = _Ids(path)
    return _TOOLS[path]


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              size: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 0,
              keep_ids: bool = False) -> DataFrame:
    """``_id, piece, start, length, ids_crc32`` (and ``ids``) of every document.

    A document is its token ids and ``end_id``; longer ones are cut every ``size`` ids.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text"))
    last = int(end_id).to_bytes(4, "little")
    step = 4 * size

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.decode("utf-8", "replace") for t in texts_of(batch, "_text")]
        row, piece, length, crc, ids = [], [], [], [], []
        for i, raw in enumerate(_tool(vocabulary).of(texts)):
            raw += last
            for k, at in enumerate(range(0, len(raw), step)):
                part = raw[at:at + step]
                row.append(i)
                piece.append(k)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
        piece_array = np.array(piece, dtype=np.int64)
        out = [batch.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
               pa.array(piece_array * size), pa.array(length, pa.int64()),
               pa.array(crc, pa.int64())]
        names = ["_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            out.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    return map_batches(rows, cut, f"_id {id_type}, piece int, start long, length long, "
                       "ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def _places(plan: Plan, counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Runs of pieces in order of falling length: where each starts, and where it goes.

    A run is one slot of one plan entry: its k-th piece goes to sequence ``first + k`` at
    ``offset``. The number of runs is bounded by plan entries, not by documents.
    """
    start, at = {}, 0
    for length in sorted(counts, reverse=True):
        start[length] = at
        at += counts[length]
    runs, sequence = [], 0
    for n, items in plan:
        offset = 0
        for length in items:
            runs.append((start[length], sequence, offset))
            start[length] += n
            offset += length
        sequence += n
    runs.sort()
    table = np.array(runs or [(0, 0, 0)], dtype=np.int64)
    return {"from": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
         vocabulary: str = "word_bpe_49k.json", end_id: int = 0) -> DataFrame:
    """``_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Pieces are written once without their ids; the histogram (at most ``size`` rows) gives
    the plan; the position of a piece in order of length, id and piece picks its run.
    """
    pieces = cut_lineage(pieces_of(docs, id_col, text_col, size, vocabulary, end_id))
    counts = {int(r["length"]): int(r["count"])
              for r in pieces.groupBy("length").count().collect()}    # at most ``size`` rows
    places = _places(packing_plan(counts, size), counts)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(pos: pd.Series) -> pd.DataFrame:
        run = np.searchsorted(places["from"], pos.to_numpy(), side="right") - 1
        return pd.DataFrame({
            "sequence_id": places["sequence"][run] + pos.to_numpy() - places["from"][run],
            "offset": places["offset"][run]})

    ordered = with_position(pieces, [F.col("length").desc(), F.col("_id"), F.col("piece"),
                                     F.col("ids_crc32")])
    return (ordered.withColumn("_place", placed("pos"))
            .select("_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id",
                    "_place.offset"))
