"""Piece encoding with seeded merge-dropout and its lossless decoding.

A text is marked at its start and its spaces as the public piece vocabulary does, split into
chunks that no piece crosses, and merged by an agenda: the best-scored adjacent pair first,
the leftmost on ties. Each candidate taken from the agenda is skipped with chance
``dropout``, decided by a hash of the key, the chunk's place in the text and the candidate's
number in the chunk's agenda; so a key always gives the same pieces, another key gives others,
and every result decodes to the same text. Without dropout the pieces are the library's. The
key of a document is a hash of the seed and its id, so each occurrence of a word in each
document is split for itself.

Chunks of equal length are merged side by side, as columns of matrices: a step takes the best
candidate of every chunk, hashes its number, and joins or skips it. So all occurrences of a
group of texts cost a few array operations a step; only chunks of more than ``WIDE`` letters go
through an agenda of their own, by the same law.

Defined cases: null counts as empty; an empty text has no pieces; characters outside the
vocabulary, and the space mark itself, are written as bytes; texts are read whole; repeated
rows are done each; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import map_batches, mix, prepare, spread, texts_of

MARK = "▁"
#: Letters whose chunks are merged together.
LETTERS = 1 << 19
#: Longest chunk merged as a column; a candidate's place in it is the low bits of its order.
WIDE = 64

_PLACE, _NUMBER = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32((1 << 31) - 1)
_CUT = re.compile(f"[^ {MARK}\n] ")
_INNER_MARK = re.compile(f"[^{MARK}]{MARK}")


class PairTable:
    """Merges by (left, right) symbol in an open-addressed table, looked up for arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        bits = max(len(pairs) * 6, 2).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.order = np.full(1 << bits, _NONE, dtype=np.int32)
        self.joined = np.zeros(1 << bits, dtype=np.int32)
        wanted = np.array([left << 32 | right for left, right in pairs], dtype=np.int64)
        for key, at, (order, joined) in zip(wanted.tolist(), self._slots(wanted).tolist(),
                                            pairs.values(), strict=True):
            while self.keys[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.order[at], self.joined[at] = key, order, joined

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _NUMBER >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (``_NONE``: no merge) and joined symbol of every pair."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slots(keys)
        found = self.keys[at]
        far = np.flatnonzero((found != keys) & (found >= 0))
        while len(far):
            at[far] = at[far] + 1 & self.mask
            found[far] = self.keys[at[far]]
            far = far[(found[far] != keys[far]) & (found[far] >= 0)]
        return np.where(found == keys, self.order[at], _NONE), self.joined[at]


def _utf8(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, one after the other, and how many each has."""
    sizes = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
    owner = np.repeat(np.arange(len(letters)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner)) - 1   # bytes to follow
    size, letter = sizes[owner], letters[owner] >> 6 * left
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    return np.where(left == size - 1, lead | letter, 0x80 | letter & 0x3F), sizes


class PieceCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_at = [0] * 256
        plain = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes_at[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[piece] = i
        self.ids = plain
        self.rank = {p: -model.get_score(i) for p, i in plain.items()}
        if any(_INNER_MARK.search(p) for p in plain):
            raise ValueError("a piece of this vocabulary crosses words")
        self.text_of = [p.replace(MARK, " ") for p in self.pieces]
        for b, i in enumerate(self.bytes_at):        # a lone byte waits for the others
            self.text_of[i] = bytes([b]).decode("utf-8", "surrogateescape")
        # Symbols: pieces, then letters that are no pieces themselves, then every other letter.
        letters = sorted({x for p in plain for x in p} - plain.keys())
        symbol = plain | {x: size + i for i, x in enumerate(letters)}
        self.no_piece, self.other = size, size + len(letters)
        self.symbol_of = np.full(0x110000, self.other, dtype=np.int32)
        for x, i in symbol.items():
            if len(x) == 1:
                self.symbol_of[ord(x)] = i
        places = {r: n for n, r in enumerate(sorted(set(self.rank.values())))}
        if len(places) * WIDE >= _NONE:
            raise ValueError("too many scores for the order of candidates")
        self.pairs = PairTable({
            (symbol[p[:cut]], symbol[p[cut:]]): (places[self.rank[p]] * WIDE, i)
            for p, i in plain.items() for cut in range(1, len(p))
            if p[:cut] in symbol and p[cut:] in symbol})
        self.byte_ids = np.array(self.bytes_at, dtype=np.int32)

    def merge(self, chunk: str, skipped: Sequence[int] = b"") -> tuple[list[str], int]:
        """Pieces of a chunk and the number of candidates taken.

        The candidate of number n is skipped if ``skipped[n]`` is set; further ones are not.
        """
        parts = list(chunk)
        n = len(parts)
        rank = self.rank
        pairs = ((rank.get(chunk[i:i + 2]), i) for i in range(n - 1))
        agenda = [(r, i, chunk[i], chunk[i + 1]) for r, i in pairs if r is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        taken, known = 0, len(skipped)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            taken += 1
            if taken <= known and skipped[taken - 1]:
                continue
            joined = left + right
            parts[i], parts[j] = joined, ""
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                r = rank.get(joined + parts[k])
                if r is not None:
                    heapq.heappush(agenda, (r, i, joined, parts[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(parts[h] + joined)
                if r is not None:
                    heapq.heappush(agenda, (r, h, parts[h], joined))
        return [p for p in parts if p], taken

    def _merge_columns(self, symbols: np.ndarray, bases: np.ndarray, limit: np.uint64) -> None:
        """Merge every column of ``symbols`` in place; letters that were joined on become -1."""
        length, width = symbols.shape
        flat = symbols.reshape(-1)
        order, joined = self.pairs.find(flat[:-width], flat[width:])
        here = np.arange(length - 1, dtype=np.int32).repeat(width)
        order = np.where(order == _NONE, _NONE, order | here).reshape(length - 1, width)
        order = np.vstack([order, np.full((1, width), _NONE, np.int32)])
        joined = np.concatenate([joined, np.zeros(width, np.int32)])
        after = np.arange(1, length + 1, dtype=np.int32).repeat(width)
        before = np.arange(-1, length - 1, dtype=np.int32).repeat(width)
        column, number = np.arange(width), 0
        while True:
            best = order.min(axis=0)
            live = best != _NONE
            left = np.count_nonzero(live)
            if not left:
                return
            if left < 0.8 * len(column):
                order = np.ascontiguousarray(order[:, live])
                column, bases, best = column[live], bases[live], best[live]
                live = np.ones(left, dtype=bool)
            size = len(column)
            now = order.reshape(-1)
            at = np.flatnonzero(live)
            place = best[at] & (WIDE - 1)
            now[place * size + at] = _NONE
            if limit:
                step = np.uint64(number * int(_NUMBER) & 0xFFFFFFFFFFFFFFFF)
                kept = mix(bases[at] + step) >> np.uint64(32) >= limit
                at, place = at[kept], place[kept]
            number += 1
            col = column[at]
            i = place.astype(np.int64) * width + col
            second = after[i].astype(np.int64)
            j = second * width + col
            flat[i], flat[j] = joined[i], -1
            now[second * size + at] = _NONE
            third = after[j]
            after[i] = third
            more, less = np.flatnonzero(third < length), np.flatnonzero(before[i] >= 0)
            k = third[more].astype(np.int64) * width + col[more]
            before[k] = place[more]
            prior = before[i[less]].astype(np.int64)
            h = prior * width + col[less]
            new, piece = self.pairs.find(np.concatenate([flat[i[more]], flat[h]]),
                                         np.concatenate([flat[k], flat[i[less]]]))
            start = np.concatenate([place[more], prior.astype(np.int32)])
            now[start.astype(np.int64) * size + np.concatenate([at[more], at[less]])] = np.where(
                new == _NONE, _NONE, new | start)
            joined[np.concatenate([i[more], h])] = piece

    def _merged(self, letters: np.ndarray, first: np.ndarray, bases: np.ndarray,
                limit: np.uint64) -> np.ndarray:
        """Symbol at the first letter of every piece, -1 at the others."""
        out = self.symbol_of[letters]
        lengths = np.diff(first, append=len(letters))
        by_length = np.argsort(lengths, kind="stable")
        known, begin = np.unique(lengths[by_length], return_index=True)
        for length, rows in zip(known.tolist(), np.split(by_length, begin[1:]), strict=True):
            if length == 1:
                continue
            if length <= WIDE:
                at = first[rows] + np.arange(length)[:, None]
                symbols = np.ascontiguousarray(out[at])
                self._merge_columns(symbols, bases[rows], limit)
                out[at] = symbols
                continue
            for row in rows.tolist():                # long: an agenda of its own
                start = int(first[row])
                chunk = letters[start:start + length].astype("<u4").tobytes().decode("utf-32-le")
                numbers = np.arange(3 * (length - 1), dtype=np.uint64)
                flags = mix(bases[row] + numbers * _NUMBER) >> np.uint64(32) < limit
                pieces, _ = self.merge(chunk, flags.tobytes())
                sizes = np.array([len(x) for x in pieces])
                own = out[start:start + length].copy()
                out[start:start + length] = -1
                at = np.cumsum(sizes) - sizes
                out[start + at] = [self.ids[x] if n > 1 else own[i]
                                   for x, n, i in zip(pieces, sizes.tolist(), at.tolist(),
                                                      strict=True)]
        return out

    def _coded(self, cuts: list[tuple[int, int, str]], keys: np.ndarray,
               dropout: float) -> list[np.ndarray]:
        """Ids of pieces of texts, given as (text, place of the first letter, letters)."""
        sizes = np.array([len(x) for _, _, x in cuts])
        starts = np.cumsum(sizes) - sizes
        letters = np.frombuffer("".join(x for _, _, x in cuts).encode("utf-32-le"), "<u4")
        letters = letters.astype(np.int32)
        mark = ord(MARK)
        literal = letters == mark                    # goes through bytes
        first_of_text = starts[[place == 0 for _, place, _ in cuts]]
        literal[first_of_text] = False               # the mark before the text
        space = letters == ord(" ")
        space[first_of_text] = True
        letters[space] = mark
        line = letters == ord("\n")
        edge = line | literal
        new = edge.copy()
        new[1:] |= edge[:-1] | space[1:] & ~space[:-1]
        new[starts] = True
        first = np.flatnonzero(new)
        cut = np.searchsorted(starts, first, side="right") - 1
        places = first - starts[cut] + np.array([p for _, p, _ in cuts])[cut]
        key = keys[np.array([t for t, _, _ in cuts])[cut]]
        bases = mix(key + places.astype(np.uint64) * _PLACE)
        out = self._merged(letters, first, bases, np.uint64(int(dropout * (1 << 32))))
        out[literal] = self.other
        at = np.flatnonzero(out >= 0)
        ids = out[at]
        counts = np.ones(len(at), dtype=np.int64)
        spelled = np.flatnonzero(ids >= self.no_piece)
        ends = np.searchsorted(at, starts[1:])       # pieces before every further cut
        if len(spelled):
            raw, counts[spelled] = _utf8(letters[at[spelled]])
            ids = np.repeat(ids, counts)
            ids[np.repeat(out[at] >= self.no_piece, counts)] = self.byte_ids[raw]
            ends = np.concatenate([[0], np.cumsum(counts)])[ends]
        return np.split(ids, ends)

    def encode_all(self, texts: list[str], keys: list[int] | np.ndarray,
                   dropout: float = 0.0) -> list[np.ndarray]:
        """Piece ids of every text, each under its key (64 bits)."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        keys = np.asarray(keys, dtype=np.uint64)
        cuts: list[tuple[int, int, str]] = []
        size = 0

        def flush() -> None:
            if cuts:
                for (t, _, _), ids in zip(cuts, self._coded(cuts, keys, dropout), strict=True):
                    out[t].append(ids)
                cuts.clear()

        for t, text in enumerate(texts):
            start = 0
            while start < len(text):                 # long texts are cut between chunks
                cut = _CUT.search(text, start + LETTERS) if len(text) - start > LETTERS else None
                end = cut.end() - 1 if cut else len(text)
                cuts.append((t, start + 1, text[start:end]) if start
                            else (t, 0, MARK + text[:end]))
                size += end - start
                start = end
                if size > LETTERS:
                    flush()
                    size = 0
        flush()
        return [np.concatenate([*x, np.zeros(0, np.int32)]).astype("<u4") for x in out]

    def encode(self, text: str, key: int = 0, dropout: float = 0.0) -> np.ndarray:
        """Piece ids of a text."""
        return self.encode_all([text], [key], dropout)[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; bytes that lie side by side form characters."""
        text = "".join(map(self.text_of.__getitem__, ids.tolist()))
        if not text.isascii():
            try:
                text.encode("utf-8")
            except UnicodeEncodeError:
                text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, PieceCodec] = {}


def codec(name: str = "piece_bpe_32k.model") -> PieceCodec:
    """The worker's codec of a vocabulary, read once."""
    import public_tokenizers
    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str = "piece_bpe_32k.model", dropout: float = 0.1,
           seed: int = 1) -> DataFrame:
    """``_id, text_hash, ids`` of every row, in one pass without a shuffle.

    ``text_hash`` is the 64-bit hash of the text, by which a decoder sees that it lost nothing.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"),
                       F.xxhash64(F.lit(seed), F.col(id_col)).alias("_key"),
                       F.xxhash64(text).alias("text_hash"), text.alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.decode("utf-8", "replace") for t in texts_of(batch, "_text")]
        keys = batch.column("_key").to_numpy().view(np.uint64)
        ids = codec(vocabulary).encode_all(texts, keys, dropout)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("text_hash"), lists],
                                          ["_id", "text_hash", "ids"])
    return map_batches(spread(rows), run, f"_id {id_type}, text_hash long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """``_id, text_hash, n_pieces, ids_crc32, text`` of rows of piece ids."""
    prepare(encoded.sparkSession)
    id_type = encoded.schema["_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(vocabulary)
        ids = [np.zeros(0, "<u4") if x is None else np.asarray(x, dtype="<u4")
               for x in (v.values.to_numpy() if v.is_valid else None
                         for v in batch.column("ids"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("text_hash"),
             pa.array([len(x) for x in ids], pa.int64()),
             pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
             pa.array([tool.decode(x) for x in ids], pa.string())],
            ["_id", "text_hash", "n_pieces", "ids_crc32", "text"])
    return map_batches(encoded, run, f"_id {id_type}, text_hash long, n_pieces long, "
                       "ids_crc32 long, text string")
