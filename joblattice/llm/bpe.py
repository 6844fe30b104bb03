"""Byte-pair merging with a heap and a linked list; token counts of a public vocabulary.

The count of a word is its number of first symbols less the number of merges made, so no
token numbers are produced. Pieces are found as the library's file describes them: special
strings first, then NFC, white space, lower case, the word pattern and bytes as symbols
with a word end on the last one.

Defined cases: null counts as empty (no tokens); texts are read whole; repeated rows are
counted each; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from joblattice.llm.common import map_batches, prepare, spread, texts_of

#: Distinct words a Python worker remembers, twice at most (an older generation stays).
REMEMBERED = 300_000

# White space as the vocabulary file's pattern sees it, and characters that
# Python also splits at though that pattern does not.
FILE_SPACE = r"\t-\r \x85\xa0  -     　"
PYTHON_ONLY_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + FILE_SPACE + r"\p{L}\p{N}]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine (each worker asks for its own)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = [""] * 256
    for b in shown:
        symbols[b] = chr(b)
    for extra, b in enumerate(b for b in range(256) if not symbols[b]):
        symbols[b] = chr(256 + extra)
    return symbols


class MergeCounter:
    """Counts tokens of texts under one byte-pair vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks: dict[tuple[str, str], int] = {
            tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = regex.compile(
            "(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.word = regex.compile(WORD_PATTERN)
        self.space = regex.compile(f"[{FILE_SPACE}]+")
        self.seen: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def symbol_count(self, word: str) -> int:
        """Tokens of one piece: symbols less merges."""
        raw = word.encode("utf-8")
        parts = [self.symbols[b] for b in raw]
        if not parts:
            return 0
        parts[-1] += self.end
        return len(parts) - self.merges(parts)

    def merges(self, parts: list[str]) -> int:
        """Number of merges: pop the lowest rank (leftmost first), join, look at neighbours."""
        n = len(parts)
        ranks = self.ranks
        agenda = []
        for i in range(n - 1):
            rank = ranks.get((parts[i], parts[i + 1]))
            if rank is not None:
                agenda.append((rank, i, parts[i], parts[i + 1]))
        if not agenda:
            return 0
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = 0
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if j >= n or parts[i] != left or parts[j] != right:
                continue                                # one side has been merged meanwhile
            joined = left + right
            parts[i], parts[j] = joined, ""
            k = after[j]
            after[i] = k
            made += 1
            if k < n:
                before[k] = i
                rank = ranks.get((joined, parts[k]))
                if rank is not None:
                    heapq.heappush(agenda, (rank, i, joined, parts[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get((parts[h], joined))
                if rank is not None:
                    heapq.heappush(agenda, (rank, h, parts[h], joined))
        return made

    def pieces(self, chunk: str) -> list[str]:
        """Pieces of a run without white space, within which merges stay."""
        text = unicodedata.normalize("NFC", chunk)
        # One character at a time, as the file's lower-casing has no final sigma.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.word.findall(text)

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.symbol_count, self.pieces(chunk)))

    def _plain(self, text: str) -> int:
        if any(c in text for c in PYTHON_ONLY_SPACE):
            chunks: Iterable[str] = self.space.split(text)
        else:
            chunks = text.split()
        seen, total = self.seen, 0
        for chunk in chunks:
            n = seen.get(chunk)
            if n is None:
                n = self.older.get(chunk)
                if n is None:
                    n = self._chunk(chunk)
                if len(seen) >= REMEMBERED:
                    self.older, self.seen = seen, {}
                    seen = self.seen
                if len(chunk) <= 64:
                    seen[chunk] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings count one each."""
        if not self.special or not any(t in text for t in self.special):
            return self._plain(text)
        return sum(1 if i % 2 else self._plain(part)
                   for i, part in enumerate(self.special_split.split(text)))


_COUNTERS: dict[str, MergeCounter] = {}


def counter(name: str) -> MergeCounter:
    """The worker's counter of a vocabulary, read once."""
    path = name if os.path.isabs(name) else vocabulary_path(name)
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """``_id, n_bytes, n_tokens, over_limit`` of every row, in one pass without a shuffle.

    ``vocabulary`` is a file name of the public collection or an absolute path.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = counter(vocabulary)
        texts = texts_of(batch, "_text")
        tokens = [tool.count(t.decode("utf-8", "replace")) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array([len(t) for t in texts], pa.int64()),
             pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
            ["_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(rows, count,
                       f"_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
