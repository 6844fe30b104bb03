"""Conversation repair against a plain search over all cheapest edits."""

import hashlib
import random
import sys
import zlib
from functools import cache

import pytest

from joblattice.llm import conversation

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}
sys.setrecursionlimit(50_000)              # the plain search recurses over all rows


def best(symbols):
    """(cost, least audit) by dynamic programming over the audit strings themselves."""
    n = len(symbols)

    @cache
    def cost(at, state, inserts):
        found = [0] if at == n and state in (0, 3) else []
        if inserts < 2:
            found.append(5 + cost(at, GIVEN[state], inserts + 1))
        if at < n:
            for c, _, to in moves(symbols[at], state):
                found.append(c + cost(at + 1, to, 0))
        return min(found, default=10 ** 9)

    def moves(symbol, state):
        out = [(2, "D", state)]
        if symbol != "x":
            more = 5 if symbol.isupper() else 0
            if symbol.lower() in NEXT[state]:
                out.append((more, "K", NEXT[state][symbol.lower()]))
            out.append((1 + more, "R", GIVEN[state]))
        return out

    @cache
    def audit(at, state, inserts):
        goal = cost(at, state, inserts)
        if at == n and state in (0, 3) and goal == 0:
            return ""
        found = []
        if inserts < 2 and 5 + cost(at, GIVEN[state], inserts + 1) == goal:
            found.append("I" + audit(at, GIVEN[state], inserts + 1))
        if at < n:
            found += [letter + audit(at + 1, to, 0) for c, letter, to in moves(symbols[at], state)
                      if c + cost(at + 1, to, 0) == goal]
        return min(found)
    return cost(0, 0, 0), audit(0, 0, 0)


@pytest.mark.parametrize("length", [0, 1, 2, 3, 7, 15, 16, 17, 33, 60])
def test_auction_finds_the_cheapest_and_least_edits(length):
    rng = random.Random(length)
    for _ in range(9 if length == 1 else 150):
        symbols = "".join(rng.choices("xsuaoSUAO", [1, 2, 5, 5, 1, 1, 2, 2, 1], k=length))
        assert conversation.solve(symbols) == best(symbols), symbols


def test_pieces_give_the_same_audit():
    rng = random.Random(3)
    for _ in range(60):
        symbols = "".join(rng.choices("xsuaoSUAO", k=rng.randint(0, 50)))
        cuts = sorted(rng.randint(0, len(symbols)) for _ in range(rng.randint(0, 4)))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]
        import pyarrow as pa
        rows = [{"part": 0, "piece": k, "matrix": conversation._matrix(p), "blank": 0,
                 "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "turns": 0}
                for k, p in enumerate(parts)]
        between = conversation._between(pa.Table.from_pylist(rows)).to_pylist()
        state, audit = 0, ""
        for row, p in zip(between, parts, strict=True):
            steps = [conversation._ARCS[s] for s in p]
            letters, state = conversation._trace(
                steps, conversation._prices(steps, row["exits"]), state)
            audit += letters
        audit += conversation._END_EDITS[state]
        assert (between[0]["cost"], audit) == best(symbols)


def brute(rows):
    groups = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        group = groups.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            group.append((turn, role, text))
    out = []
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                  hashlib.md5(r[2].encode()).hexdigest()))
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in group:
            fault = None
            if not text.strip(" \t\n\v\f\r"):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif text.rstrip(" \t\n\v\f\r")[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbol = role[:1] if role[:1] in ("s", "u", "a") and role[:1] else "o"
            symbols += "x" if fault in ("blank", "duplicate") else (
                symbol.upper() if fault else symbol)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                      for a, b in zip(group, group[1:], strict=False))
        turns = [r[0] for r in group if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = best(symbols)
        lines, k, last = [], 0, ""
        for letter in audit:
            if letter in "IR":
                role = "assistant" if last == "u" else "user"
                lines.append((role, "" if letter == "I" else group[k][2]))
            if letter == "K":
                lines.append(group[k][1:])
            if letter != "D":
                last = lines[-1][0][0]
            k += letter != "I"
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("_conv", "_turn", "_part", "audit", "cost", "part"):
        df = df.selectExpr("*", f"7 AS `{name}`")
    return sorted((tuple(r) for r in conversation.repaired_hashes(df).collect()), key=repr)


def talk(conv, n, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No", " \t\n", "", None, "Très bien !", "what? ", "ok.\x0b", "long " * 50]
    return [(conv, rng.choice([k, k, k, k + 1]) if n < 100 else k,
             rng.choices(roles, [1, 5, 5, 1, 1, 1])[0],
             rng.choice([*texts, f"Row {k}.", f"Row {k}", f"And {k}!"])) for k in range(n)]


def test_query_rows_by_brute_force(spark):
    rows = [r for c in range(150) for r in talk(c, c % 9 + 1, c)]
    rows += [(None, None, None, None), (None, None, "user", "Hi."), (None, 3, "user", "Hi."),
             (900, None, "user", "A."), (900, None, "user", "A."), (901, 1, "user", "x " * 3_000_000)]
    assert run(spark, rows) == brute(rows)


def test_long_conversation_is_spread_over_pieces(spark):
    rows = talk(5, 600, 1) + [(5, None, "user", "Again.")] * 40
    rows += [r for c in (1, 9) for r in talk(c, 8, c)]
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert run(spark, rows) == want
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small = conversation.repair(conversation.damaged(df), piece_rows=7)
    assert sorted((tuple(r) for r in small.collect()), key=repr) == want


def test_empty_table_and_dropped_rows(spark):
    assert run(spark, []) == []
    gone = [k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:5]
    rows = [(k, 0, "user", "Hi.") for k in gone]
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, rows) == sorted([(k, 0, 0, 0, 0, 0, 0, "", empty) for k in gone], key=repr)


def test_query_on_the_given_table(spark):
    from joblattice.llm.queries import QUERIES
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
