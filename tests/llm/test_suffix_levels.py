"""Repeated passages against a plain table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from joblattice.llm import suffix_levels

WORDS = ["".join(random.Random(i).choices("abcdefgh", k=3 + i % 5)) for i in range(200)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def brute(rows, length):
    places = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for k, (_, raw) in enumerate(raws):
        for at in range(len(raw) - length + 1):
            places.setdefault(raw[at:at + length], []).append((k, at))
    cover = [np.zeros(len(raw), bool) for _, raw in raws]
    for found in places.values():
        if len(found) > 1:
            for k, at in found:
                cover[k][at:at + length] = True
    out = []
    for (i, raw), c in zip(raws, cover, strict=True):
        kept = bytes(np.frombuffer(raw, np.uint8)[~c])
        runs = int((np.diff(c.astype(int), prepend=0) == 1).sum())
        out.append((i, len(raw), int(c.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(4)
    shared = [prose(120, f"p{k}") for k in range(4)]
    rows = [(i, prose(rng.randint(5, 200), i)) for i in range(30)]
    for i in range(40):
        parts = [prose(rng.randint(0, 60), f"a{i}"), rng.choice(shared)[rng.randint(0, 300):],
                 prose(rng.randint(0, 60), f"b{i}"), rng.choice(shared)[:rng.randint(300, 600)]]
        rows.append((100 + i, " ".join(parts)))
    base = prose(300, "base")
    rows += [(200 + i, base) for i in range(6)]
    rows += [(210 + i, base[:700] + f" {i} " + base[700:]) for i in range(6)]
    near = prose(64, "edge")[:399]
    rows += [(220, "x" + near), (221, "y" + near), (222, near + "q"), (223, near + "q")]
    rows += [(230, "a" * 399), (231, "a" * 400), (232, "a" * 401), (233, "ab" * 900),
             (234, "é" * 300 + "ü" * 300), (235, "ü" * 200 + "é" * 300)]
    rows += [(240, None), (241, ""), (242, None), (None, prose(90, "n")), (None, prose(90, "n")),
             (7, prose(90, "m")), (7, prose(90, "m"))]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_id", "_text", "key", "_d", "found", "n_bytes"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    got = suffix_levels.remove_repeats(df, **how)
    assert got.columns == ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_every_string_is_assigned_once():
    rng = random.Random(1)
    texts = [bytes(rng.choices(range(97, 100), k=n)) for n in (0, 399, 400, 401, 5_000)]
    texts += [b"z" * 3_000, bytes(rng.choices(range(256), k=2 * suffix_levels.BLOCK + 77))]
    index, keys, places, counts, _ = suffix_levels.sample(texts)
    for i, text in enumerate(texts):
        covered = [p + k for p, c in zip(places[index == i], counts[index == i], strict=True)
                   for k in range(c)]
        assert covered == list(range(max(len(text) - 399, 0)))
    assert len(keys[index == 5]) == 1


def test_equal_strings_share_a_fingerprint():
    rng = random.Random(2)
    passage = bytes(rng.choices(range(97, 123), k=400))
    texts = [bytes(rng.choices(range(97, 123), k=rng.randint(0, 900))) + passage
             + bytes(rng.choices(range(97, 123), k=rng.randint(0, 900))) for _ in range(20)]
    index, keys, places, counts, _ = suffix_levels.sample(texts)
    seen = set()
    for i, text in enumerate(texts):
        at = text.index(passage)
        hit = (index == i) & (places <= at) & (at < places + counts)
        assert hit.sum() == 1
        seen.add(keys[hit][0])
    assert len(seen) == 1


def test_hash_collisions_are_told_apart(monkeypatch):
    real = suffix_levels.string_hashes
    monkeypatch.setattr(suffix_levels, "string_hashes", lambda *a: real(*a) % np.uint64(3))
    pieces = [b"abcdefghij", b"xxabcdexx", b"zzzzzz"]
    got = suffix_levels.repeated_strings(pieces, 4)
    raw = b"".join(pieces)
    every = [p for n, s in ((10, 0), (9, 10), (6, 19)) for p in range(s, s + n - 3)]
    want = [p for p in every if sum(raw[p:p + 4] == raw[q:q + 4] for q in every) > 1]
    assert got.tolist() == want


@pytest.mark.parametrize("how", [{}, {"batches": 1}, {"hot_bytes": 3_000}, {"hot_bytes": 0}])
def test_rows_by_brute_force(spark, how):
    rows = passages()
    assert run(spark, rows, **how) == brute(rows, 400)


def test_long_text(spark):
    word = prose(120, "p0")[:500]
    text = prose(400_000, "long")
    rows = [(1, text[:1_500_000] + word + text[1_500_000:]), (2, "head " + word), (3, "y" * 3_000_000)]
    got = {r[0]: r[1:4] for r in run(spark, rows)}
    assert got[1][1:] == (500, 1) or got[1][1] >= 500
    assert got[2][1] >= 500 and got[3] == (3_000_000, 3_000_000, 1)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_levels_grow_like_a_binary_counter(spark):
    rows = [r for r in passages() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    levels = suffix_levels.SuffixLevels(spark)
    sizes = []
    for k in range(6):
        part = suffix_levels.sampled(df.where(f"pmod(doc_id, 6) = {k}"))
        levels.append(part)
        sizes.append([n for n, _ in levels.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    held = sum(spark.table(t).count() for _, t in levels.levels)
    every = suffix_levels.sampled(df).dropDuplicates(["_sha"]).selectExpr("size(keys) AS n")
    assert held == every.agg({"n": "sum"}).first()[0]
    levels.close()


def test_a_known_text_in_a_later_batch_is_not_indexed_again(spark):
    df = spark.createDataFrame([(1, prose(200, "k"))], "doc_id long, text string")
    levels = suffix_levels.SuffixLevels(spark)
    first = levels.append(suffix_levels.sampled(df)).count()
    second = levels.append(suffix_levels.sampled(df)).count()
    levels.close()
    assert first == second == 0


def test_levels_are_scanned_without_a_shuffle(spark):
    df = spark.createDataFrame(passages(), "doc_id long, text string")
    levels = suffix_levels.SuffixLevels(spark, buckets=4)
    levels.append(suffix_levels.sampled(df))
    table = spark.table(levels.levels[0][1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.join(table.select("key"), "key", "left_semi")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        levels.close()
    assert "Exchange" not in plan.split("Physical Plan")[1]


def test_query_on_the_given_table(spark):
    from joblattice.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = QUERIES["op12_suffix_levels"](spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 400)
