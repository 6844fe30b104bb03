"""Merkle manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest

from joblattice.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    out = ""
    for value in (*row[:4], text):
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def grow(nodes):
    """(root, path of each node) of a tree with runs of 8; a path is [(left, right), ...]."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_under = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at:at + 8]
            for k in range(len(run)):
                for i in under[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            up_under.append([i for u in under[at:at + 8] for i in u])
        nodes, under = up, up_under
    return (nodes[0] if nodes else None), paths


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0,
                                             leaf_of(row, row[4]), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        inner[name] = grow([x[2] for x in trees[name]])
    root, tops = grow([inner[name][0] for name in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        subroot, paths = inner[name]
        for (_, _, leaf, row), path in zip(trees[name], paths, strict=True):
            path = path + top
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(row, text)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((row[0], leaf, subroot, root, sha("".join(a + b for a, b in path)),
                        folded, folded == root))
    return sorted(out, key=repr)


def run(spark, rows, **extra):
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("_tree", "leaf", "path", "kids", "lo", "pos", "_id", "root"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    got = merkle.proofs(df)
    assert got.columns == ["_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                           "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


CASES = {
    "one": [(5, "s", "en", 2, "Ab")],
    "lone leaves": [(i, "s", f"l{i}", 2, f"Ab{i}") for i in range(10)] + [(90, None, None, None, None)],
    "uneven": [(i, f"s{i % 3}", "de", i, f"Text {i}") for i in range(9)]
    + [(100 + i, None, "en", None, "X" * i) for i in range(66)]
    + [(300 + i, "ß", "é", 3, "ÄB") for i in range(8)]
    + [(400, "", "", 0, ""), (401, "a", None, 1, None)],
    "ties and nulls": [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (7, "s", "en", 1, "B"),
                       (7, "s", "en", 1, "B"), (7, "t", "en", 1, "B"), (3, None, "en", None, "C")],
    "long": [(1, "s", "en", 1, "Wort " * 400_000), (2, "s", "en", 1, "y")],
}


@pytest.mark.parametrize("name", CASES)
def test_proofs_by_brute_force(spark, name):
    rows = CASES[name]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_tampering_shows_only_where_letters_change(spark):
    rows = [(i, "s", "en", 1, "low" if i % 2 else "Up") for i in range(60)]
    hit = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 0}
    got = {r[0]: r[6] for r in run(spark, rows)}
    assert got == {i: not (i in hit and i % 2 == 0) for i in range(60)}


def test_query_on_the_given_table(spark):
    from joblattice.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
