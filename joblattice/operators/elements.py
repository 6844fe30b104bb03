"""Elements of stored HTML as rows: cards within containers, fields within cards.

Markup is cut at its tags; a row is a tag with the text after it. An element's end is found
by the depth of its name: the running count of opening and closing tags of that name gives
each tag a level, and the next tag of the same name and level closes it. Whether a tag lies
inside an element of some kind is a running maximum of such ends. So nothing ends at the
first closing tag of any name, nested markup stays in its field, and a selector's containers
are respected. Pages meet only their own rows; the windows of a page share one sort order.

Elements left open run to the next element of their level, or to the page's end. What lies in
nested cards belongs to the innermost one; of nested fields of one kind the last begun counts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import BLOCK_TAGS, UNRENDERED, decode_entities
from ..functions.text import let, strip
from .compute import compute_once

#: Characters of markup that one task cuts into tags; its windows hold some fifty times as much.
TASK_CHARS = 4 << 20


class Tag(NamedTuple):
    """Columns of a tag that a test may ask for."""

    name: Column
    attrs: Column       # as written
    classes: Column     # class attribute


#: A test of an opening tag.
Test = Callable[[Tag], Column]

# Elements that have no end tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
             "source", "track", "wbr")
_FAR = 1 << 30


def _raw_attribute(attrs: Column, name: str) -> Column:
    pattern = rf"""(?is)(?:^|[\s"']){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return F.btrim(F.regexp_extract(attrs, pattern, 1), F.lit("\"'"))


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute, entities decoded; empty if absent."""
    return decode_entities(_raw_attribute(attrs, name))


def has_class(classes: Column, *wanted: str) -> Column:
    """One of the words of a class attribute is one of ``wanted``."""
    return F.arrays_overlap(F.split(classes, r"\s+"), F.array(*[F.lit(c) for c in wanted]))


def tags_of(pages: DataFrame, key: str, html: str, tests: dict[str, Test]) -> DataFrame:
    """``key, at, name, closing, attrs, text, single, level, ends``: a row a tag and its text.

    ``ends`` of an opening tag is the place of the tag that closes it; ``single`` tags close
    themselves. Every test is a column, false for closing tags. Comments, scripts,
    styles and noscript are left out; a ``<`` that begins no tag is text.
    """
    markup = F.regexp_replace(F.coalesce(html, F.lit("")), UNRENDERED, "")
    pieces = pages.select(key, F.posexplode(F.split(markup, "<(?=/?[A-Za-z])")).alias("at", "p"))
    inner = F.substring_index("p", ">", 1)
    rows = pieces.where("at > 0").select(
        key, "at", F.lower(F.regexp_extract("p", "^/?([A-Za-z][A-Za-z0-9]*)", 1)).alias("name"),
        F.col("p").startswith("/").alias("closing"),
        F.regexp_replace(inner, "^/?[A-Za-z][A-Za-z0-9]*", "").alias("attrs"),
        F.substring("p", F.length(inner) + 2, F.length("p")).alias("text"))
    # Tests are evaluated once a tag; the windows below carry their results.
    rows = compute_once(rows, {"_classes": _raw_attribute(F.col("attrs"), "class")})
    tag = Tag(F.col("name"), F.col("attrs"), F.col("_classes"))
    rows = compute_once(rows, {n: ~F.col("closing") & F.coalesce(t(tag), F.lit(False))
                               for n, t in tests.items()}).drop("_classes")
    single = F.col("name").isin(*VOID_TAGS) | (F.right(F.rtrim("attrs"), F.lit(1)) == "/")
    by_name = Window.partitionBy(key, "name").orderBy("at")
    step = F.when(F.col("single"), 0).when(F.col("closing"), -1).otherwise(1)
    level = (F.sum(step).over(by_name)
             + F.when(F.col("closing") & ~F.col("single"), 1).otherwise(0))
    leveled = rows.withColumn("single", single).withColumn("level", level)
    by_level = Window.partitionBy(key, "name", "single", "level").orderBy("at")
    ends = F.when(F.col("single"), F.col("at") + 1).otherwise(
        F.coalesce(F.lead("at").over(by_level), F.lit(_FAR)))
    return leveled.withColumn("ends", F.when(~F.col("closing"), ends))


def _innermost(rows: DataFrame, key: str, hit: str, name: str) -> DataFrame:
    """Add the start of the innermost open element marked by ``hit``; NULL outside of all.

    Openings less closings of marked elements give a depth; at a depth the last opening is
    the one a tag lies in, also after an inner element has ended.
    """
    by_level = Window.partitionBy(key, "name", "single", "level").orderBy("at")
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    closes = F.col("closing") & F.coalesce(F.lag(hit).over(by_level), F.lit(False))
    rows = rows.withColumn("_closes", closes)
    step = F.col(hit).cast("int") - F.col("_closes").cast("int")
    rows = rows.withColumn("_depth", F.sum(step).over(so_far))
    at_depth = Window.partitionBy(key, "_depth").orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col(hit), F.col("at")), ignorenulls=True).over(at_depth)
    return rows.withColumn(name, F.when(F.col("_depth") > 0, start)).drop("_closes", "_depth")


def spread_pages(pages: DataFrame, key: str, html: str, task_chars: int = TASK_CHARS) -> DataFrame:
    """``key`` and ``html`` in as many partitions by key as the size of the markup asks for.

    All windows below keep to a page, so this is the only exchange, of markup and not of tags.
    """
    rows = pages.select(key, html)
    size = rows.agg(F.sum(F.length(html))).first()[0] or 0
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-size // task_chars)), key)


def cards(pages: DataFrame, key: str, html: str, within: list[Test], card: Test,
          fields: dict[str, Test], first_in_scope: bool = False,
          holding: Test | None = None) -> DataFrame:
    """``key, at, attrs, parts`` and one array a field, of every card in page order.

    ``within`` are the containers a card must lie in, from the outside; ``first_in_scope``
    keeps the first card of each innermost container; with ``holding``, only elements that
    are the innermost ones around such a tag count as cards. ``parts`` and the fields hold the
    texts: ``array<struct<at, start, attrs, breaks, text>>``, ``start`` being the element a
    text is in, ``attrs`` its tag's.
    """
    tests = {f"_w{i}": t for i, t in enumerate(within)} | {"_hit": card}
    tests |= {f"_h_{name}": t for name, t in fields.items()}
    if holding is not None:
        tests["_holds"] = holding
    rows = tags_of(spread_pages(pages, key, html), key, html, tests).withColumn("_in", F.lit(True))
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(within)):
        hit = F.col(f"_w{i}") & F.col("_in")
        end = F.max(F.when(hit, F.col("ends"))).over(so_far)
        rows = rows.withColumns({"_scope_hit": hit, "_end": end}).withColumn(
            "_in", F.coalesce((F.col("_end") > F.col("at")) & ~F.col("_scope_hit"), F.lit(False)))
    if first_in_scope:
        rows = _innermost(rows, key, "_scope_hit", "_scope")
    rows = rows.withColumn("_hit", F.col("_hit") & F.col("_in"))
    if first_in_scope:
        before = F.count(F.when(F.col("_hit"), 1)).over(
            Window.partitionBy(key, "_scope").orderBy("at").rowsBetween(
                Window.unboundedPreceding, -1))
        rows = rows.withColumn("_hit", F.col("_hit") & (before == 0))
    if holding is not None:
        rows = _innermost(rows, key, "_hit", "_around")
        any_held = F.max(F.col("_holds") & ~F.col("_hit")).over(Window.partitionBy(key, "_around"))
        rows = rows.withColumn("_hit", F.col("_hit") & any_held).drop("_around")
    rows = _innermost(rows, key, "_hit", "_card").where(F.col("_card").isNotNull())
    rows = rows.withColumns({f"_f_{n}": F.last(
        F.when(F.col(f"_h_{n}") & ~F.col("_hit"), F.struct("at", "ends", "attrs")),
        ignorenulls=True).over(so_far) for n in fields})
    breaks = F.col("name").isin(*BLOCK_TAGS.split("|"))

    def entry(start: Column, attrs: Column) -> Column:
        return F.struct("at", start.alias("start"), attrs.alias("attrs"), breaks.alias("breaks"),
                        decode_entities(F.col("text")).alias("text"))

    def gathered(name: str) -> Column:
        field = F.col(f"_f_{name}")
        held = (field["at"] > F.col("_card")) & (F.col("at") < field["ends"])
        return F.sort_array(F.collect_list(F.when(held, entry(field["at"], field["attrs"])))
                            ).alias(name)
    return (rows.groupBy(key, F.col("_card").alias("_at"))
            .agg(F.min_by("attrs", "at").alias("attrs"),
                 F.sort_array(F.collect_list(entry(F.col("_card"), F.lit(None).cast("string"))))
                 .alias("parts"),
                 *[gathered(n) for n in fields])
            .withColumnRenamed("_at", "at"))


def first_of(field: Column) -> Column:
    """The texts of the field's first element."""
    return let(field, lambda v: F.filter(v, lambda x: x["start"] == F.get(v, F.lit(0))["start"]))


def joined(parts: Column) -> Column:
    """The stripped texts without anything between them."""
    return F.array_join(F.transform(parts, lambda x: strip(x["text"])), "")


def each_joined(field: Column) -> Column:
    """One joined text for each element of the field."""
    return let(field, lambda v: F.transform(
        F.array_distinct(F.transform(v, lambda x: x["start"])),
        lambda s: joined(F.filter(v, lambda x: x["start"] == s))))


def rendered(parts: Column) -> Column:
    """Text as lines: block elements break, white space inside a line is one blank."""
    raw = F.array_join(F.transform(parts, lambda x: F.concat(
        F.when(x["breaks"], F.lit("\u0001")).otherwise(F.lit("")), x["text"])), "")
    lines = F.transform(F.split(raw, "\u0001"),
                        lambda s: strip(F.regexp_replace(s, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


# --- the same in one row, for small fragments ---------------------------------------------

def pieces_of(html: Column) -> Column:
    """Markup cut before its tags: each piece but the first is a tag with the text after it."""
    markup = F.regexp_replace(F.coalesce(html, F.lit("")), UNRENDERED, "")
    return F.split(markup, "<(?=/?[A-Za-z])")


def piece_name(piece: Column) -> Column:
    """Name of a piece's tag in lower case, with a slash if it closes."""
    return F.lower(F.regexp_extract(piece, "^/?[A-Za-z][A-Za-z0-9]*", 0))


def piece_classes(piece: Column) -> Column:
    return _raw_attribute(F.substring_index(piece, ">", 1), "class")


def element_at(pieces: Column, names: Column, at: Column) -> Column:
    """The pieces of the element that begins at index ``at``, without its closing tag.

    One pass over what follows counts opening and closing tags of the same name.
    """
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def inner(at: Column, name: Column) -> Column:
        def step(acc: Column, other: Column) -> Column:
            depth = (acc["depth"] + (other == name).cast("int")
                     - (other == F.concat(F.lit("/"), name)).cast("int"))
            return F.when(acc["depth"] == 0, acc).otherwise(F.struct(
                depth.alias("depth"), (acc["n"] + (depth > 0).cast("int")).alias("n")))
        rest = F.slice(names, at + 2, F.size(names))
        return F.when(name.isin(*VOID_TAGS), F.lit(0)).otherwise(
            F.aggregate(rest, start, step, lambda acc: acc["n"]))
    # ``let``: the index and the name are values inside the pass, not computed for each step.
    return let(at, lambda i: F.slice(
        pieces, i + 1, let(F.get(names, i), lambda name: inner(i, name)) + 1))


def joined_pieces(pieces: Column) -> Column:
    """The stripped texts of pieces without anything between them."""
    return F.array_join(F.transform(pieces, lambda x: strip(decode_entities(
        F.substring(x, F.length(F.substring_index(x, ">", 1)) + 2, F.length(x))))), "")
