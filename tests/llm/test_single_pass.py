"""Token counts, sequence packing, html text, exact copies and shards on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from joblattice.llm import bpe, exact_dedup, html_text, packing, sharding

LONG = "word " * 30_000
HARD = ["", None, " \t\n", "a", "It's 2024 … ÄÖ", "<|endoftext|> tail", "x" * 5000, LONG,
        "same text", "same text", "same  text\n", "日本語 テキスト", "Σίσυφος ΟΔΟΣ", "\x1c\x1f|"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))


def test_token_counts_equal_library(documents, as_dict, library):
    got = as_dict(bpe.token_counts(documents(list(enumerate(HARD)))))
    for i, text in enumerate(HARD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), text
        assert got[i]["n_bytes"] == len((text or "").encode())
        assert got[i]["over_limit"] == (len(ids) > 2048)


def test_token_counts_of_random_texts(library):
    rng = random.Random(5)
    tool = bpe.counter("word_bpe_49k.json")
    pool = "abcdeXYZ'stlmdrv019 ½!?.,<|>\t\n\r\x85\xa0éÉßσς̈́한你😀"
    for _ in range(500):
        text = "".join(rng.choices(pool, k=rng.randint(0, 40)))
        assert tool.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_packing_rows(documents, library):
    rows = packing.pack(documents(list(enumerate(HARD)))).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in HARD]
    for i, want in enumerate(ids):
        parts = sorted((r for r in rows if r["_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["length"] for r in parts[:-1]] == [2048] * (len(parts) - 1)
        assert sum(r["length"] for r in parts) == len(want)
        for r in parts:
            cut = want[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(cut, dtype="<u4").tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(len(x) for x in ids) // 2048)


def _fewest(items, size):
    best = len(items)
    items = sorted(items, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= size}.values():
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        place(i + 1, bins)
        bins.pop()
    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rng = random.Random(7)
    for _ in range(400):
        items = [rng.randint(rng.choice([1, 3, 5]), 20) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_by_dominance(dict(Counter(items)), 20)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + _fewest(left, 20) == _fewest(items, 20)
        plan = packing.packing_plan(dict(Counter(items)), 20)
        assert all(sum(group) <= 20 for _, group in plan)
        used = Counter()
        for n, group in plan:
            for x in group:
                used[x] += n
        assert used == Counter(items)


def test_exact_copies_by_brute_force(documents, as_dict):
    got = as_dict(exact_dedup.copies(documents(list(enumerate(HARD)))))
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in HARD]
    for i, n in enumerate(norm):
        group = [j for j, m in enumerate(norm) if m == n]
        keep = min(group, key=lambda j: (-len(HARD[j] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (
            keep, len(group), keep == i)
        assert got[i]["_sha"] == hashlib.sha256(n.encode()).hexdigest()


def test_drop_copies_keeps_one_row_of_each_text(documents):
    docs = documents([(1, "a b"), (1, "a b"), (None, "ab"), (2, "a  b"), (3, None), (4, "")])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_empty_tables(documents):
    none = documents([])
    assert exact_dedup.copies(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert packing.pack(none).count() == 0
    assert bpe.token_counts(none).count() == 0
    assert sharding.hilbert_shards(none).count() == 0


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        index = sharding.hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(documents):
    rows = sharding.hilbert_shards(documents([(i % 90, HARD[i % len(HARD)]) for i in range(101)]),
                                   16).collect()
    assert len(rows) == 101
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    ordered = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)


PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
     "<nav><ul><li><a href=/a>One</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy now.</div>"
     "<article><h1>Head &amp; line</h1><p><b>Bold\n  text<br><p>Pa.</p><p>x&lt;y &#233;</p>"
     "</article><footer>&copy; me</footer>", "Head & line Bold text Pa. x<y é"),
    ("<div id='main-content'><p>Some words stand here and they go on for a while.</p>"
     "<div class='comments'><p>I like it a lot, really.</p></div></div>",
     "Some words stand here and they go on for a while."),
    ("<form>Name <input></form><article>Only</article><aside>Side</aside>", "Only"),
    ("<article><p>open paragraph <!-- never closed", "open paragraph"),
    ("", ""), (None, ""), ("<p></p>", ""),
]


def test_html_text(spark, as_dict):
    df = spark.createDataFrame([(i, f"u{i}", h, "z") for i, (h, _) in enumerate(PAGES)],
                               "page_id long, url string, html string, `_url` string")
    got = as_dict(html_text.extract(df))
    for i, (_, want) in enumerate(PAGES):
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))


@pytest.mark.parametrize("inner", [
    "<svg viewBox='0 0 1 1'/>", "<math/>", "<object-card>", "<button>", "<video src=a>", "<select>",
    "<object data=x>", "<svg><svg><text>no</text></svg><text>no</text></svg>",
    "<BUTTON>no</BUTTON >", "<script>no</script>"])
def test_html_hidden_elements_end(inner):
    page = f"<article><p>one</p>{inner}<p>two</p><p>three</p></article><p><svg>no</svg></p>"
    assert html_text.main_text(page) == "one two three"


def test_tree_fits_its_table():
    for page in html_text.labelled_pages():
        blocks = html_text.blocks_of(page)
        keep = html_text.fitted_tree().predict(html_text.features(blocks))
        assert [b[0].startswith("+") for b in blocks] == list(keep), page[:80]


def _paragraphs(*sizes):
    return "".join(f"<p>{' '.join(f'w{k}' for k in range(n))}</p>" for n in sizes)


@pytest.mark.parametrize("opening", [
    '<div class="content no-sidebar">', '<div id="page" class="has-header">',
    '<section class="story notice-board">', '<div class="post-body ad-free">', "<div>",
    '<div class="sidebar-layout">', '<div class="has-sidebar with-banner">',
    '<main class="footer-sticky">'])
def test_words_of_furniture_do_not_hide_an_article(opening):
    closing = f"</{re.match('<([a-z]+)', opening)[1]}>"
    body = "<h1>Big Head</h1>" + _paragraphs(40, 5, 30) + "<h2>Part</h2>" + _paragraphs(25)
    want = html_text.main_text(f"<article>{body}</article>")
    assert want.split()[:3] == ["Big", "Head", "w0"] and len(want.split()) == 103
    page = (f'<ul><li><a href="/">home</a></li></ul>{opening}{body}<div class="sidebar">'
            f'{_paragraphs(12)}</div>{closing}<div class="comments">{_paragraphs(20, 30)}</div>')
    assert html_text.main_text(page) == want


def test_headline_container_stays_and_furniture_goes():
    post = ('<div class="post"><div class="post-header"><h1>Big Head</h1></div>'
            f'{_paragraphs(40)}<div class="post-comments">{_paragraphs(30)}</div></div>')
    assert len(html_text.main_text(post).split()) == 42
    # A long thread under a short article is no layout, nor is a page of furniture alone.
    thread = (f'<div class="content">{_paragraphs(20)}</div><div class="comments">'
              f'{_paragraphs(200, 200)}</div>')
    assert len(html_text.main_text(thread).split()) == 20
    assert html_text.main_text(f'<div class="sidebar">{_paragraphs(30)}</div>') == ""
    beside = (f'<div class="content">{_paragraphs(20)}</div><div class="sidebar">'
              f'{_paragraphs(100, 100)}</div>')
    assert len(html_text.main_text(beside).split()) == 20
