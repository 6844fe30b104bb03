"""Merkle manifest of a table: subtrees by partition, proofs by nested intervals of leaf ranks.

Every row is a leaf. Inside a subtree (a language) leaves are ranked by id; a node of level
``k`` covers the ranks ``[lo, hi)`` and carries them as its label. Nodes meet by the bucket
``lo div 8^k``, in which one node of that level at most begins, so attaching parents and
ancestors is an equi-join whatever the size of a subtree; the parts of a parent's interval
left and right of a node's own are its siblings. Everything is DataFrame functions; a level is
an eighth of the one below it, and a parent's path is sent once for its eight children.

Defined cases: null values hash as ``-``, empty ones as ``0:``; ids that tie (nulls too) are
ordered by leaf hash; repeated rows are leaves of their own, with equal results; a null id is
never tampered; a subtree of one row is its leaf; an empty table has no rows and no root;
very long texts are hashed once where they are read; only the named columns are read and the
output has its own names, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import with_position
from joblattice.operators.compute import broadcast_if_small
from joblattice.session import cut_lineage

#: Children of a node.
FANOUT = 8

_PATH = "array<struct<left:string,right:string>>"


def hash_of(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts joined."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(doc_id: Column) -> Column:
    """Whether a row counts as tampered with: 3 divides the CRC-32 of its decimal id."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return doc_id.isNotNull() & (crc % 3 == 0)


def leaves(docs: DataFrame, id_col: str, tree_col: str, other_cols: list[str],
           text_col: str) -> DataFrame:
    """``_id, _tree, leaf, altered``: hash of every row, and of the row after tampering."""
    head = [field(F.col(c)) for c in [id_col, *other_cols]]
    text = F.col(text_col)
    leaf = hash_of(*head, field(text))
    return docs.select(
        F.col(id_col).alias("_id"), F.col(tree_col).cast("string").alias("_tree"),
        leaf.alias("leaf"),
        F.when(tampered(F.col(id_col)), hash_of(*head, field(lower_ascii(text))))
        .alias("altered"))


def _level_up(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` from those below: ``_tree, lo, hi, hash, kids`` (label and hash).

    ``lo`` and ``hi`` are leaf ranks; children whose intervals begin in one bucket of
    ``8^level`` ranks are those the parent contains, 8 at most.
    """
    width = FANOUT ** level
    kid = F.struct("lo", "hi", "hash", *[c for c in ("_id", "altered") if c in nodes.columns])
    runs = nodes.groupBy("_tree", F.expr(f"lo div {width}").alias("_bucket")).agg(
        F.sort_array(F.collect_list(kid)).alias("kids"))
    return runs.select(
        "_tree", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
        F.sha2(F.array_join(F.transform("kids", lambda k: k["hash"]), ""), 256).alias("hash"),
        "kids")


def _paths_to_kids(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Children of nodes with a ``path``: interval differences inside the parent, put before it."""
    own = F.col("_kid")

    def part(test):
        inside = F.filter("kids", test)
        return F.array_join(F.transform(inside, lambda k: k["hash"]), "")
    step = F.struct(part(lambda k: k["hi"] <= own["lo"]).alias("left"),
                    part(lambda k: k["lo"] >= own["hi"]).alias("right"))
    return (nodes.withColumn("_kid", F.explode("kids"))
            .select("_tree", *[own[c].alias(c) for c in columns],
                    F.concat(F.array(step).cast(_PATH), "path").alias("path")))


def _climb(nodes: DataFrame, sizes: DataFrame, tallest: int) -> list[DataFrame]:
    """Tables of the levels 1, 2, ...: a tree takes part while several of its nodes remain."""
    levels = []
    below = nodes
    width, level = 1, 1
    while (tallest + width - 1) // width > 1:
        open_trees = sizes.where(F.expr(f"n > {width}")).select("_tree")
        going = below.join(broadcast_if_small(open_trees),
                           below["_tree"].eqNullSafe(open_trees["_tree"]), "left_semi")
        below = cut_lineage(_level_up(going, level))
        levels.append(below)
        below = below.drop("kids")
        width, level = width * FANOUT, level + 1
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame, columns: list[str]) -> DataFrame:
    """Paths of all leaves of trees of several leaves, from the paths of their ``tops``.

    ``tops``: ``_tree, n, path``. A level's nodes meet their parents' children by tree and
    interval; a tree begins at the level of which one node covers all its ranks.
    """
    paths = None
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        t = tops.select(F.col("_tree").alias("_t"), "n", F.col("path").alias("_top"))
        first = level.join(t, F.col("_tree").eqNullSafe(F.col("_t")) & (F.col("lo") == 0)
                           & (F.col("hi") == F.col("n"))).select(level["*"],
                                                                F.col("_top").alias("path"))
        if paths is not None:
            p = paths.select(F.col("_tree").alias("_t"), F.col("lo").alias("_lo"),
                             F.col("hi").alias("_hi"), "path")
            inner = level.join(p, F.col("_tree").eqNullSafe(F.col("_t")) & (
                F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))
            first = first.unionByName(inner.select(level["*"], "path"))
        paths = _paths_to_kids(first, ["lo", "hi"] if k > 1 else columns)
        if k > 1:
            paths = cut_lineage(paths)
    return paths


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang",
             other_cols: tuple[str, ...] = ("source", "lang", "n_chars"),
             text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(leaves, trees) of ``docs``.

    ``leaves``: ``_id, _tree, leaf, altered, path``, the path being the siblings' hashes left
    and right of the row's node, level by level up to the root. ``trees``: one row a subtree,
    ``_tree, n, subroot, root``.
    """
    spark = docs.sparkSession
    rows = cut_lineage(leaves(docs, id_col, tree_col, list(other_cols), text_col))
    order = [F.col("_tree").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("leaf")]
    placed = with_position(rows, order)
    sizes = cut_lineage(placed.groupBy("_tree").agg(F.count("*").alias("n"),
                                                    F.min("pos").alias("_start")))
    starts = broadcast_if_small(sizes.select(F.col("_tree").alias("_t"), "_start"))
    ranked = cut_lineage(
        placed.join(starts, F.col("_tree").eqNullSafe(F.col("_t")))
        .select("_tree", (F.col("pos") - F.col("_start")).alias("lo"),
                (F.col("pos") - F.col("_start") + 1).alias("hi"), F.col("leaf").alias("hash"),
                "_id", "altered"))
    tallest = sizes.agg(F.max("n")).first()[0] or 0
    levels = _climb(ranked, sizes, tallest)

    whole = [t.select("_tree", "lo", "hi", F.col("hash").alias("subroot"))
             for t in [ranked, *levels]]
    all_nodes = whole[0].where("lo = 0 and hi = 1")
    for t in whole[1:]:
        all_nodes = all_nodes.unionByName(t.where("lo = 0"))
    s = sizes.select(F.col("_tree").alias("_t"), "n")
    roots = cut_lineage(all_nodes.join(s, F.col("_tree").eqNullSafe(F.col("_t"))
                                       & (F.col("hi") == F.col("n")))
                        .select("_tree", "n", "subroot").dropDuplicates(["_tree"]))
    trees = _join_subtrees(roots)
    tops = trees.select("_tree", "n", "path")
    columns = ["_id", "hash", "altered"]
    alone = tops.where("n = 1").select(F.col("_tree").alias("_t"), F.col("path"))
    single = ranked.join(alone, F.col("_tree").eqNullSafe(F.col("_t"))).select(
        "_tree", *columns, "path")
    many = _descend(levels, broadcast_if_small(tops.where("n > 1")), columns)
    paths = single if many is None else many.unionByName(single)
    result = paths.select("_id", "_tree", F.col("hash").alias("leaf"), "altered", "path")
    return result, broadcast_if_small(trees.select("_tree", "n", "subroot", "root"))


def _join_subtrees(roots: DataFrame) -> DataFrame:
    """``_tree, n, subroot, root, path``: the tree over the subroots in order of their names."""
    spark = roots.sparkSession
    ordered = with_position(roots, [F.col("_tree").asc_nulls_first()], "lo")
    nodes = cut_lineage(ordered.select(
        F.lit(None).cast("string").alias("_tree"), "lo", (F.col("lo") + 1).alias("hi"),
        F.col("subroot").alias("hash"), F.col("_tree").alias("_id"), F.col("n").alias("altered")))
    count = nodes.count()
    start = spark.createDataFrame([(None, count, [])], f"_tree string, n long, path {_PATH}")
    if count <= 1:
        return cut_lineage(nodes.select(
            F.col("_id").alias("_tree"), F.col("altered").alias("n"), F.col("hash").alias("subroot"),
            F.col("hash").alias("root"), F.array().cast(_PATH).alias("path")))
    levels = _climb(nodes, start.select("_tree", "n"), count)
    root = levels[-1].first()["hash"]
    found = _descend(levels, F.broadcast(start), ["_id", "hash", "altered"])
    return cut_lineage(found.select(
        F.col("_id").alias("_tree"), F.col("altered").alias("n"), F.col("hash").alias("subroot"),
        F.lit(root).alias("root"), "path"))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings' hashes, level by level from the leaf, left to right."""
    steps = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(steps, ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proofs(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang",
           other_cols: tuple[str, ...] = ("source", "lang", "n_chars"),
           text_col: str = "text") -> DataFrame:
    """``_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``folded_root`` is recomputed from the tampered leaf, where the row is tampered with,
    and the original siblings.
    """
    rows, trees = manifest(docs, id_col, tree_col, other_cols, text_col)
    t = trees.select(F.col("_tree").alias("_t"), "subroot", "root")
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    return (rows.join(t, F.col("_tree").eqNullSafe(F.col("_t")))
            .select("_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias(
                "proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
