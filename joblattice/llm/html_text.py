"""Main text of web pages: flat text blocks, features of neighbours, a decision tree.

A page becomes a flat list of text blocks. Each has its word count and link density, those
of the block before and after, and where it stands. A decision tree fitted on a small table
of labelled blocks (``labelled_pages``) says which blocks are main text.

Names of elements tell furniture and main parts only as far as they are plain: of an element's
names the first that says either counts, and names of a state (``no-sidebar``, ``has-header``,
``ad-free``) say nothing. An element that is furniture by such a name, but holds nearly all
words of a page without being mostly links, is the page's layout and counts as unnamed.

Defined cases: null, empty or markup-only pages give an empty text; unclosed elements last
to the end of what holds them, an unclosed comment or raw-text element (``RAW``) to the end of
the page; other hidden elements hide what is before their end tag, and nothing without one; pages
are read whole; repeated rows are done each; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from joblattice.llm.common import map_batches, prepare, spread, texts_of

# HTML element names and the words that name page furniture.
RAW = ("script", "style", "noscript", "iframe", "textarea", "title")
HIDDEN = frozenset("template svg math object select button canvas video audio".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
                   "q s samp small span strike strong sub sup time tt u var wbr".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog head fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav "
    "navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot sidebar side "
    "aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe signup login form search share sharing social related recommended comment comments "
    "disqus reply replies respond copyright legal pagination pager toolbar skip".split())
MAIN_WORDS = frozenset("article content main post story entry body text".split())
# Words that make a name one of a state, and heads of main parts.
STATE_WORDS = frozenset("no not non has have with without is hide hides hidden disable disabled".split())
HEAD_WORDS = frozenset("header masthead".split())
#: Furniture words that may as well name a page's layout.
LAYOUT_WORDS = frozenset("header masthead topbar footer sidebar side aside widget banner promo "
                         "notice notices alert overlay social share sharing related skip".split())

#: Share and least number of a page's unlinked words that make furniture by name its layout.
LAYOUT_SHARE, LAYOUT_WORDS_LEAST = 0.8, 60

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>]|\Z)[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after",
            "density_after", "in_main", "in_boiler", "heading")


def _said(name: str) -> tuple[int, bool]:
    """What one name says, as ``_place``, and whether it may name a layout."""
    words = [p.lower() for p in _PART.findall(name)]
    if not words or words[0] in STATE_WORDS or words[-1] == "free":
        return 0, False
    boiler = BOILER_WORDS.intersection(words)
    main = not MAIN_WORDS.isdisjoint(words)
    if boiler:
        if main and boiler <= HEAD_WORDS:            # the headline of a main part
            return 0, False
        return -1, boiler <= LAYOUT_WORDS
    return int(main), False


def _place(tag: str, attrs: str, inside_main: bool) -> tuple[int, bool]:
    """-1 page furniture, 1 main part, 0 neither; whether the element may be a layout."""
    if tag in BOILER_TAGS or (tag == "header" and not inside_main):
        return -1, False
    if attrs and tag not in ("html", "body"):
        for m in _NAME.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").split():
                place, layout = _said(name)
                if place > 0 or place < 0 and tag not in MAIN_TAGS:
                    return place, layout
    return int(tag in MAIN_TAGS), False


def _hidden_ends(tokens: list[re.Match]) -> dict[int, int]:
    """Where each hidden element that has an end tag begins and ends."""
    open_at: dict[str, list[int]] = {}
    ends = {}
    for token in tokens:
        tag = (token["tag"] or "").lower()
        if tag not in HIDDEN:
            continue
        held = open_at.setdefault(tag, [])
        if token["close"]:
            if held:
                ends[held.pop()] = token.end()
        elif not (tag in ("svg", "math") and token["attrs"].endswith("/")):
            held.append(token.start())
    return ends


def blocks_of(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """Flat blocks in order: text, words, words in links, in main, in furniture, heading."""
    blocks = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int]] = []
    layouts: list[int] = []                          # open elements that may be a layout
    within: list[tuple[int, ...]] = []               # of every block
    link = heading = number = 0
    main = boiler = 0

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = len(html.unescape(" ".join(linked)).split()) if linked else 0
                words = text.count(" ") + 1
                blocks.append((text, words, min(links, words), int(main > 0), int(boiler > 0),
                               int(heading > 0)))
                within.append(tuple(layouts))
            parts.clear()
            linked.clear()

    at = 0
    tokens = list(_TOKEN.finditer(page))
    ends = _hidden_ends(tokens)
    for token in tokens:
        if token.start() < at:                       # inside a hidden element
            continue
        if token.start() > at:
            piece = page[at:token.start()]
            parts.append(piece)
            if link:
                linked.append(piece)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in HIDDEN and not token["close"]:
            at = ends.get(token.start(), at)
            continue
        if tag == "a":
            link = 0 if token["close"] else 1
            continue
        if tag in INLINE and not token["attrs"]:
            continue
        if tag in INLINE:
            # Inline elements end no block, but may be furniture by name.
            if token["close"] or tag in _VOID or _place(tag, token["attrs"], main > 0)[0] >= 0:
                if not token["close"]:
                    continue
        close_block()
        if token["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    for name, place, layout in stack[depth:]:
                        main -= place == 1
                        boiler -= place == -1 and not layout
                        heading -= name in HEADINGS
                        if layout:
                            layouts.remove(layout)
                    del stack[depth:]
                    break
            if tag not in INLINE:
                link = 0
            continue
        if tag in _VOID or token["attrs"].endswith("/") and tag in INLINE:
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            _, place, layout = stack.pop()
            main -= place == 1
            boiler -= place == -1 and not layout
            if layout:
                layouts.remove(layout)
        place, may_be_layout = _place(tag, token["attrs"], main > 0)
        number += 1
        stack.append((tag, place, number if may_be_layout else 0))
        main += place == 1
        if may_be_layout:
            layouts.append(number)
        else:
            boiler += place == -1
        heading += tag in HEADINGS
    if at < len(page):
        parts.append(page[at:])
        if link:
            linked.append(page[at:])
    close_block()
    return _without_layouts(blocks, within)


def _without_layouts(blocks: list[tuple], within: list[tuple[int, ...]]) -> list[tuple]:
    """Blocks with furniture by name told from the page's layout, by words and links."""
    plain, linked, main = Counter(), Counter(), Counter()
    sure = [(b, w) for b, w in zip(blocks, within, strict=True) if not b[4]]
    for block, open_ones in sure:                    # what is surely furniture counts nowhere
        for layout in open_ones:
            plain[layout] += block[1] - block[2]
            linked[layout] += block[2]
            main[layout] += block[3]
    least = max(LAYOUT_SHARE * sum(b[1] - b[2] for b, _ in sure), LAYOUT_WORDS_LEAST)
    mains = sum(b[3] for b, _ in sure)               # no layout leaves a main part outside
    found = {x for x, n in plain.items()
             if n >= least and linked[x] < n / 2 and main[x] == mains}
    return [b if b[4] or found.issuperset(w) else (*b[:4], 1, b[5])
            for b, w in zip(blocks, within, strict=True)]


def features(blocks: list[tuple]) -> np.ndarray:
    """One row of ``FEATURES`` a block; the page's ends count as empty blocks."""
    words = np.array([b[1] for b in blocks], dtype=float)
    density = np.array([b[2] for b in blocks], dtype=float) / np.maximum(words, 1)
    pad = lambda x: np.concatenate([[0.0], x, [0.0]])            # noqa: E731
    w, d = pad(words), pad(density)
    rest = np.array([b[3:] for b in blocks], dtype=float).reshape(len(blocks), 3)
    return np.column_stack([words, density, w[:-2], d[:-2], w[2:], d[2:], rest])


# --- the tree ---------------------------------------------------------------------------

class Tree:
    """Binary decision tree by Gini impurity; ties go to the first feature and lowest cut."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, max_depth: int = 6,
                 min_rows: int = 2):
        self.nodes: list[tuple[int, float, int, int, bool]] = []
        self._grow(rows, labels.astype(float), max_depth, min_rows)

    def _grow(self, rows: np.ndarray, labels: np.ndarray, depth: int, least: int) -> int:
        me = len(self.nodes)
        share = labels.mean()
        self.nodes.append((-1, 0.0, -1, -1, bool(share >= 0.5)))
        if depth == 0 or len(labels) < 2 * least or share in (0.0, 1.0):
            return me
        best = None
        for f in range(rows.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            values, ones = rows[order, f], np.cumsum(labels[order])
            left = np.arange(1, len(values))
            right = len(values) - left
            p, q = ones[:-1] / left, (ones[-1] - ones[:-1]) / right
            impurity = left * p * (1 - p) + right * q * (1 - q)
            impurity[(values[1:] == values[:-1]) | (left < least) | (right < least)] = np.inf
            at = int(np.argmin(impurity)) if len(impurity) else 0
            if len(impurity) and np.isfinite(impurity[at]) and (
                    best is None or impurity[at] < best[0] - 1e-12):
                best = (impurity[at], f, (values[at] + values[at + 1]) / 2)
        if best is None:
            return me
        _, f, cut = best
        low = rows[:, f] <= cut
        a = self._grow(rows[low], labels[low], depth - 1, least)
        b = self._grow(rows[~low], labels[~low], depth - 1, least)
        self.nodes[me] = (f, cut, a, b, self.nodes[me][4])
        return me

    def predict(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=bool)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            f, cut, a, b, label = self.nodes[node]
            if f < 0:
                out[at] = label
                continue
            low = rows[at, f] <= cut
            todo += [(a, at[low]), (b, at[~low])]
        return out


def _words(n: int) -> str:
    return " ".join(f"word{i % 7}" for i in range(n))


def _links(*sizes: int) -> str:
    return "".join(f'<li><a href="/x">{_words(n)}</a></li>' for n in sizes)


def labelled_pages() -> list[str]:
    """Small labelled table: pages whose main blocks begin with ``+``, all others with ``-``.

    Each design is laid out with and without elements that say what a part is, with short
    and long paragraphs, so that the tree must use counts and densities where names lack.
    """
    pages = []
    for lengths in ([40, 3, 25, 60, 1, 30], [80, 12, 90], [20, 35, 18, 2, 50], [1, 2, 1], [150]):
        named = "".join(f"<p>+{_words(n)}</p>" for n in lengths)
        plain = "".join(f"<div>+{_words(max(n, 12))}</div>" for n in lengths)
        pages += [
            f"<nav><ul>{_links(1, 1, 2).replace('>word', '>-word')}</ul></nav><div class=ad>-{_words(9)}"
            f"</div><article><h1>+{_words(6)}</h1>{named}</article><footer>-{_words(8)}</footer>",
            f"<header><p>-{_words(4)}</p></header><main><h2>+{_words(3)}</h2>{named}<ul><li>+"
            f"{_words(6)}</li><li>+{_words(2)}</li></ul></main><aside><p>-{_words(30)}</p></aside>"
            f"<form><p>-{_words(5)}</p></form>",
            f"<div id=content>{named}<div class=share-links>-{_words(3)}</div></div><div class=comments>"
            f"<p>-{_words(45)}</p><p>-{_words(20)}</p></div><div class=cookie-notice>-{_words(25)}</div>",
            f"<article>{named}</article>",
            f"<p>-{_words(4)}</p><main>{named}</main><p>-{_words(7)}</p><p>-{_words(3)}</p>",
            f"<article>{named}<div class=comments><p>-{_words(60)}</p><p>-{_words(2)}</p></div>"
            f"<nav><p>-{_words(20)}</p></nav></article>",
            f"<ul>{_links(1, 2, 1, 3).replace('>word', '>-word')}</ul>{plain}<div>-{_words(3)}</div>"
            f"<ul>{_links(2, 4).replace('>word', '>-word')}</ul><p>-{_words(5)}</p>",
            f"<table><tr><td><a href=/>-{_words(2)}</a></td><td><a href=/b>-{_words(3)}</a></td></tr>"
            f"</table>{plain}<p><a href=/c>-{_words(12)}</a></p><p><a href=/d>-{_words(5)}</a></p>",
        ]
    # Nothing says what is what: headings and short paragraphs between longer ones are main.
    for a, b, c in ((40, 30, 25), (20, 60, 35), (80, 15, 50), (28, 18, 22)):
        body = (f"<h1>+{_words(a % 5 + 3)}</h1><p>+{_words(a)}</p><p>+{_words(5)}</p><p>+{_words(b)}</p>"
                f"<h2>+{_words(3)}</h2><p>+{_words(c)}</p><p>+{_words(2)}</p><p>+{_words(a)}</p>"
                f"<p>+{_words(8)}</p><p>+{_words(b)}</p><h3>+{_words(1)}</h3><p>+{_words(c)}</p>")
        pages += [
            f"<ul>{_links(1, 2, 1).replace('>word', '>-word')}</ul><div>{body}</div><div>-{_words(3)}"
            f"</div><div>-{_words(6)}</div><ul>{_links(2, 3).replace('>word', '>-word')}</ul>",
            f"<div>-{_words(2)}</div><div><a href=/>-{_words(2)}</a></div>{body}"
            f"<p><a href=/e>-{_words(4)}</a></p><h4>-{_words(2)}</h4>"
            f"<ul>{_links(5, 6, 4).replace('>word', '>-word')}</ul><p>-{_words(7)}</p>",
            f"<div>{body}</div><div>-{_words(4)}</div><div>-{_words(2)}</div>",
            f"<div>-{_words(3)}</div><div class=entry>{body}</div><div>-{_words(5)}</div>",
            f"<div>-{_words(4)}</div><article><h1>+{_words(2)}</h1><p>+{_words(a)}</p></article>",
            f"<article><h1>+{_words(2)}</h1><p>+{_words(a)}</p><p>+{_words(b)}</p></article>",
        ]
    return pages


@lru_cache(maxsize=1)
def fitted_tree() -> Tree:
    """The tree of the labelled table; fitted once a process, always the same."""
    rows, labels = [], []
    for page in labelled_pages():
        blocks = blocks_of(page)
        rows.append(features(blocks))
        labels += [b[0].startswith("+") for b in blocks]
    return Tree(np.concatenate(rows), np.array(labels))


def main_text(page: str) -> str:
    """Text of the main blocks, joined by one space."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = fitted_tree().predict(features(blocks))
    return " ".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``_id, _url, text, n_chars`` of every page, in one pass without a shuffle."""
    prepare(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = spread(pages.selectExpr(f"`{id_col}` AS _id", f"`{url_col}` AS _url",
                                   f"`{html_col}` AS _html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t.decode("utf-8", "replace")) for t in texts_of(batch, "_html")]
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    return map_batches(rows, run, f"_id {id_type}, _url string, text string, n_chars long")
