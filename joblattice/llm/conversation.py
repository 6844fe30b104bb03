"""Repair of conversation structure by an auction shortest-path search over an edit lattice.

A node of the lattice is (rows read, state of the role pattern ``(s?(ua)+)?``); its arcs are the
edits Keep, Rerole, Delete and Insert with integer costs. The auction search (Bertsekas 1991)
keeps a path and node prices: the end of the path is extended along the arc of least cost plus
price, or, if its own price is lower than that, the price is raised and the path contracted.
When the path has reached nodes whose prices are exact, every cheapest path consists of tight
arcs (price = cost + next price), and the audit is traced along them, least letter first, with
dead ends marked.

Long lattices are searched in windows of rows from the last to the first, each beginning at
prices that differ from the exact ones by a bounded amount, so the work is linear in the rows.

In Spark the rows are range-sorted once with their texts. A conversation that lies within a
partition is repaired where it is read. One at the edge of a partition, or longer than
``PIECE_ROWS``, is cut into pieces: each gives its cost from every entry to every exit state,
the same auction over the pieces of a conversation gives the prices between them, the pieces
are traced in parallel, and only a running hash passes over them in order. So a conversation of
any length is spread over tasks; what one task holds of it is a piece, the matrices (16 numbers
a piece) and the audit, which the result needs in one value.

Defined cases: null role or text counts as one space, in the damage key too; rows that tie in
turn are ordered by role, then by the text's MD5; repeated rows are rows; a role's initial is
its first character, none if it is empty; a null id is a conversation like others; an empty
table has no rows; other columns are not read and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import SPACE, map_batches, prepare
from joblattice.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5

#: A conversation is cut into pieces of at most this many rows, or of rows of about so many bytes.
PIECE_ROWS = 4_096
PIECE_BYTES = 4 << 20

#: Rows of one auction; audits of shorter conversations are remembered by their lattice.
WINDOW = 16
CACHED = 65_536

_INF = 1 << 60
_BLANKS = SPACE.decode()

#: Next state after a role's initial: 0 nothing yet, 1 system, 2 user, 3 assistant.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: State after the only role that may be inserted or given.
_GIVEN = (2, 2, 3, 2)
#: Price and edits of a conversation that ends in a state.
_END = (0, 2 * INSERT, INSERT, 0)
_END_EDITS = ("", "II", "I", "")


def _arcs(symbol: str) -> list[list[tuple[int, int, int, str]]]:
    """(cost, rows read, next state, letter) of the arcs of every state, by letter.

    Symbols: ``x`` must be deleted; else the role's initial (``o`` another one), in upper
    case if the row is truncated.
    """
    extra = UNFINISHED if symbol.isupper() else 0
    out = []
    for state in range(4):
        arcs = [(DELETE, 1, state, "D"), (INSERT, 0, _GIVEN[state], "I")]
        if symbol != "x":
            kept = _AFTER[state].get(symbol.lower())
            if kept is not None:
                arcs.append((KEEP + extra, 1, kept, "K"))
            arcs.append((REROLE + extra, 1, _GIVEN[state], "R"))
        out.append(arcs)
    return out


_ARCS = {symbol: _arcs(symbol) for symbol in "xsuaoSUAO"}


def _auction(steps: list, low: int, high: int, price: list[list[int]], origins) -> None:
    """Exact prices of ``origins`` at position ``low``, given exact ones at ``high``.

    Prices between are lower bounds, exact on the paths found. Nodes that cannot reach a
    finite price at ``high`` are set aside first; no path enters them.
    """
    start = min(price[high])
    for at in range(high - 1, low - 1, -1):
        after, here = price[at + 1], [_INF] * 4
        for state in range(4):
            if any(step and after[to] < _INF for _, step, to, _ in steps[at][state]):
                here[state] = start
        for _ in range(2):                                         # inserts, two at most
            for state in range(4):
                if any(not step and here[to] < _INF for _, step, to, _ in steps[at][state]):
                    here[state] = start
        price[at] = here
    for origin in origins:
        if price[low][origin] >= _INF:
            continue
        path = [(low, origin)]
        while path[-1][0] < high:
            at, state = path[-1]
            best, target = _INF, None
            for cost, step, to, _ in steps[at][state]:
                value = cost + price[at + step][to]
                if value < best:
                    best, target = value, (at + step, to)
            if price[at][state] < best:
                price[at][state] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(target)


def _prices(steps: list, exits: list[int], origins=range(4)) -> list[list[int]]:
    """Prices of all positions, window by window from the end; exact where a window begins."""
    price: list = [None] * len(steps) + [list(exits)]
    high = len(steps)
    while high > 0:
        low = max(0, high - WINDOW)
        _auction(steps, low, high, price, range(4) if low else origins)
        high = low
    return price


def _trace(steps: list, price: list[list[int]], state: int) -> tuple[str, int]:
    """Letters and last state of the least string of tight arcs from the first position."""
    letters: list[str] = []
    low = 0
    while low < len(steps):
        high = low + (len(steps) - low - 1) % WINDOW + 1           # windows are cut from the end
        path, tried, dead = [(low, state)], [0], set()
        while path[-1][0] < high:
            at, state = path[-1]
            arcs = steps[at][state]
            k = tried[-1]
            while k < len(arcs):
                cost, step, to, _ = arcs[k]
                k += 1
                if (at + step, to) not in dead and price[at][state] == cost + price[at + step][to]:
                    tried[-1] = k
                    path.append((at + step, to))
                    tried.append(0)
                    break
            else:
                dead.add(path.pop())
                tried.pop()
        letters += [steps[at][state][k - 1][3]
                    for (at, state), k in zip(path[:-1], tried[:-1], strict=True)]
        low, state = path[-1]
    return "".join(letters), state


def solve(symbols: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    steps = [_ARCS[s] for s in symbols]
    price = _prices(steps, list(_END), (0,))
    audit, state = _trace(steps, price, 0)
    return price[0][0], audit + _END_EDITS[state]


@lru_cache(CACHED)
def _solve_short(symbols: str) -> tuple[int, str]:
    """:func:`solve`, remembered a worker."""
    return solve(symbols)


def _matrix(symbols: str) -> list[int]:
    """Cost from every entry to every exit state of a piece, row by row."""
    steps = [_ARCS[s] for s in symbols]
    columns = [_prices(steps, [0 if e == exit_ else _INF for e in range(4)])[0]
               for exit_ in range(4)]
    return [columns[e][s] for s in range(4) for e in range(4)]


# --- rows -------------------------------------------------------------------------------

def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``_conv, _turn, _role, _text, _copies``: rows after damage by a hash of id and turn.

    Of twenty hash values 0 drops the row (no copies are left), 1 empties its text, 2 removes
    its ``[.!?]``, 3 doubles it, 4 sets the role user.
    """
    blank = F.lit(" ")
    role = F.coalesce(F.col(role_col).cast("string"), blank)
    text = F.coalesce(F.col(text_col).cast("string"), blank)
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col(turn_col).cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("_role"),
        F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("_text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_copies"))


def undamaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as they are, in the form :func:`repair` takes."""
    return conversations.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("_text"),
        F.lit(1).alias("_copies"))


class _Stats:
    """Counts and lattice symbols of consecutive rows; ``fresh`` says which are new."""

    def __init__(self, turns: list, roles: list[str], texts: list[str], fresh: set[int] | None):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        seen: set = set()
        symbols = []
        before = None
        for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
            new = (role, text) not in seen if fresh is None else k in fresh
            if fresh is None:
                seen.add((role, text))
            if k and before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            before = role[:1]
            bare = text.rstrip(_BLANKS)
            symbol = before if before in ("s", "u", "a") else "o"
            if not bare:
                self.blank += 1
                symbol = "x"
            elif not new:
                self.duplicate += 1
                symbol = "x"
            elif bare[-1] not in ".!?":
                self.truncated += 1
                symbol = symbol.upper()
            symbols.append(symbol)
        self.symbols = "".join(symbols)
        known = [t for t in turns if t is not None]
        self.low, self.high = (known[0], known[-1]) if known else (None, None)
        self.turns = len(set(known))

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def repaired(roles: list[str], texts: list[str], audit: str, state: int = 0):
    """(lines ``role:text``, last state) of rows edited as the audit says."""
    lines, k = [], 0
    for letter in audit:
        if letter == "I" or letter == "R":
            role = "assistant" if state == 2 else "user"
            state = _GIVEN[state]
            lines.append(f"{role}:" + ("" if letter == "I" else texts[k]))
        elif letter == "K":
            lines.append(f"{roles[k]}:{texts[k]}")
            state = _AFTER[state][roles[k][:1]]
        k += letter != "I"
    return lines, state


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _read_runs(batches: Iterator[pa.RecordBatch], piece_rows: int):
    """(conv, part, piece number, is whole, turns, roles, texts) of a sorted partition."""
    conv = part = None
    piece = size = 0
    runs = 0                                         # conversations ended in this partition
    rows: tuple[list, list, list] = ([], [], [])
    begun = False

    def take(whole: bool):
        nonlocal rows, size, piece
        out = (conv, part, piece, whole, *rows)
        rows, size, piece = ([], [], []), 0, piece + 1
        return out

    open_ = False                                    # some pieces of this conversation are out
    for batch in batches:
        names = ("_conv", "_part", "_turn", "_role", "_text", "_copies")
        for c, p, turn, role, text, copies in zip(*[batch.column(n).to_pylist() for n in names],
                                                  strict=True):
            if begun and c != conv:
                yield take(runs > 0 and not open_)
                runs, open_ = runs + 1, False
            conv, part, begun = c, p, True
            for _ in range(copies):
                if len(rows[0]) >= piece_rows or size > PIECE_BYTES:
                    yield take(False)
                    open_ = True
                rows[0].append(turn)
                rows[1].append(role)
                rows[2].append(text)
                size += len(text)
    if begun:
        yield take(False)


_ROWS = "turns array<long>, roles array<string>, texts array<string>"


def _first_pass(schema: pa.Schema, piece_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for conv, part, piece, whole, turns, roles, texts in _read_runs(batches, piece_rows):
            row = {"_conv": conv, "part": part, "piece": piece, "whole": whole}
            if whole:
                s = _Stats(turns, roles, texts, None)
                cost, audit = (_solve_short if len(s.symbols) <= 64 else solve)(s.symbols)
                text = "\n".join(repaired(roles, texts, audit)[0])
                row |= {"gaps": s.gaps(), "blank": s.blank, "duplicate": s.duplicate,
                        "truncated": s.truncated, "illegal": s.illegal, "cost": cost,
                        "audit": audit, "sha": hashlib.sha256(text.encode()).hexdigest()}
            else:
                row |= {"turns": turns, "roles": roles, "texts": texts}
                size += sum(map(len, texts))
            out.append(row)
            if len(out) >= 2_000 or size > PIECE_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


# --- conversations in several pieces ------------------------------------------------------

_PIECE_SCHEMA = ("part int, piece int, symbols string, first string, last string, illegal long, "
                 "blank long, duplicate long, truncated long, low long, high long, turns long, "
                 "matrix array<long>")


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts, symbols and cost matrix of pieces whose new rows are known."""
    out = []
    for row in batch.to_pylist():
        s = _Stats(row["turns"], row["roles"], row["texts"], set(row["fresh"] or ()))
        out.append({
            "_conv": row["_conv"], "part": row["part"], "piece": row["piece"],
            "symbols": s.symbols, "first": row["roles"][0][:1] if row["roles"] else None,
            "last": row["roles"][-1][:1] if row["roles"] else None, "illegal": s.illegal,
            "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated, "low": s.low,
            "high": s.high, "turns": s.turns, "matrix": _matrix(s.symbols)})
    return pa.RecordBatch.from_pylist(out, pa.schema(
        [batch.schema.field("_conv"), *_MEASURED]))


_MEASURED = [pa.field(n, t) for n, t in (
    ("part", pa.int32()), ("piece", pa.int32()), ("symbols", pa.string()), ("first", pa.string()),
    ("last", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("low", pa.int64()),
    ("high", pa.int64()), ("turns", pa.int64()), ("matrix", pa.list_(pa.int64())))]


def _between(group: pa.Table) -> pa.Table:
    """Exit prices of every piece of one conversation, and its counts on each of its rows."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["piece"]))
    steps = [[[(r["matrix"][4 * s + e], 1, e, "") for e in range(4) if r["matrix"][4 * s + e] < _INF]
              for s in range(4)] for r in rows]
    high = len(steps)
    price: list = [None] * high + [list(_END)]
    while high > 0:                                                # every boundary is needed
        _auction(steps, high - 1, high, price, range(4))
        high -= 1
    total = {n: sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal")}
    filled = [r for r in rows if r["first"] is not None]
    for a, b in zip(filled, filled[1:], strict=False):
        total["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    known = [r for r in rows if r["turns"]]
    turns = sum(r["turns"] for r in known) - sum(
        a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    total["gaps"] = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
    total["cost"] = price[0][0]
    return pa.Table.from_pylist(
        [{"part": r["part"], "piece": r["piece"], "final": k == len(rows) - 1,
          "exits": price[k + 1], **total} for k, r in enumerate(rows)],
        pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("final", pa.bool_()),
                   ("exits", pa.list_(pa.int64())), *[(n, pa.int64()) for n in _COUNTS]]))


def _trace_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Audit and last state of pieces for each entry state."""
    out = []
    for row in batch.to_pylist():
        steps = [_ARCS[s] for s in row["symbols"]]
        price = _prices(steps, row["exits"])
        traced = [_trace(steps, price, s) for s in range(4)]
        if row["final"]:
            traced = [(audit + _END_EDITS[state], state) for audit, state in traced]
        out.append({"part": row["part"], "piece": row["piece"], "audits": [a for a, _ in traced],
                    "ends": [e for _, e in traced]})
    return pa.RecordBatch.from_pylist(out, pa.schema(
        [("part", pa.int32()), ("piece", pa.int32()), ("audits", pa.list_(pa.string())),
         ("ends", pa.list_(pa.int32()))]))


def _entries(group: pa.Table) -> pa.Table:
    """Entry state of every piece of one conversation: last states chained from the start."""
    state, out = 0, []
    for row in sorted(group.to_pylist(), key=lambda r: (r["part"], r["piece"])):
        out.append({"part": row["part"], "piece": row["piece"], "entry": state})
        state = row["ends"][state]
    return pa.Table.from_pylist(out, pa.schema(
        [("part", pa.int32()), ("piece", pa.int32()), ("entry", pa.int32())]))


def _hash_in_order(schema: pa.Schema):
    """Results of conversations whose pieces arrive in order; only a running hash is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, any_line, audit, row = hashlib.sha256(), False, [], None
        for batch in batches:
            for row in batch.to_pylist():
                lines, _ = repaired(row["roles"], row["texts"], row["audit"], row["entry"])
                if lines:
                    digest.update((("\n" if any_line else "") + "\n".join(lines)).encode())
                    any_line = True
                audit.append(row["audit"])
                if row["final"]:
                    yield pa.RecordBatch.from_pylist(
                        [{"_conv": row["_conv"], **{n: row[n] for n in _COUNTS},
                          "audit": "".join(audit), "sha": digest.hexdigest()}], schema)
                    digest, any_line, audit = hashlib.sha256(), False, []
    return run


def _repair_pieces(pieces: DataFrame, conv_type: str, result: str, result_schema) -> DataFrame:
    """Results of the conversations of ``pieces`` (``_conv, part, piece`` and their rows)."""
    at = F.posexplode(F.arrays_zip("roles", "texts")).alias("k", "row")
    firsts = (pieces.select("_conv", "part", "piece", at)
              .groupBy("_conv", F.col("row.roles"), F.md5(F.col("row.texts").cast("binary")))
              .agg(F.min(F.struct("part", "piece", "k")).alias("f")))
    fresh = firsts.groupBy("f.part", "f.piece").agg(F.collect_list("f.k").alias("fresh"))
    known = pieces.join(fresh, ["part", "piece"], "left").select(
        "_conv", "part", "piece", "turns", "roles", "texts", "fresh")
    measured = cut_lineage(map_batches(known, _measure, f"_conv {conv_type}, {_PIECE_SCHEMA}"))
    counts = ", ".join(f"{n} long" for n in _COUNTS)
    between = cut_lineage(measured.groupBy("_conv").applyInArrow(
        _between, f"part int, piece int, final boolean, exits array<long>, {counts}"))
    traced = cut_lineage(map_batches(
        measured.select("part", "piece", "symbols").join(
            between.select("part", "piece", "final", "exits"), ["part", "piece"]),
        _trace_pieces, "part int, piece int, audits array<string>, ends array<int>"))
    entries = cut_lineage(
        traced.select("part", "piece", "ends")
        .join(measured.select("_conv", "part", "piece"), ["part", "piece"])
        .groupBy("_conv").applyInArrow(_entries, "part int, piece int, entry int"))
    chosen = (traced.join(entries, ["part", "piece"])
              .select("part", "piece", "entry", F.col("audits")[F.col("entry")].alias("audit")))
    rows = (pieces.select("_conv", "part", "piece", "roles", "texts")
            .join(chosen, ["part", "piece"])
            .join(between.select("part", "piece", "final", *_COUNTS), ["part", "piece"]))
    return (rows.repartition("_conv").sortWithinPartitions("_conv", "part", "piece")
            .mapInArrow(_hash_in_order(result_schema), result))


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``_conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha`` a conversation.

    ``rows`` as :func:`damaged` or :func:`undamaged` give them; a conversation all of whose
    rows have no copies is returned with zeros and the hash of the empty string.
    """
    spark = rows.sparkSession
    prepare(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), F.col("_role"),
             F.col("_tie")]
    ordered = (rows.withColumn("_tie", F.md5(F.col("_text").cast("binary")))
               .repartitionByRange(parts, *order).sortWithinPartitions(*order)
               .select(F.spark_partition_id().alias("_part"), "_conv", "_turn", "_role", "_text",
                       "_copies"))
    conv_type = dict(rows.dtypes)["_conv"]
    counts = ", ".join(f"{n} long" for n in _COUNTS)
    result = f"_conv {conv_type}, {counts}, audit string, sha string"
    empty = spark.createDataFrame([], f"{result}, part int, piece int, whole boolean, {_ROWS}")
    schema = empty.toArrow().schema
    first = cut_lineage(ordered.mapInArrow(
        _first_pass(schema, piece_rows), f"{result}, part int, piece int, whole boolean, {_ROWS}"))
    names = ["_conv", *_COUNTS, "audit", "sha"]
    result_schema = pa.schema([schema.field(n) for n in names])
    pieces = first.where(~F.col("whole")).select("_conv", "part", "piece", "turns", "roles", "texts")
    return first.where("whole").select(*names).unionByName(
        _repair_pieces(pieces, conv_type, result, result_schema))


def repaired_hashes(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Damage ``conversations`` and repair them: one row for every id of the table."""
    return repair(damaged(conversations, conv_col))
