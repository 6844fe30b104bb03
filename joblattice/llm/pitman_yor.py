"""Language-model scores under a hierarchical Pitman-Yor model sampled by Gibbs.

Two levels of restaurants: one for each context, all with the unigram restaurant as parent,
whose own parent is uniform over the known words and one unknown. The context of a token is
the whole word before it (a mark of its own at the start of a text), so there are as many
restaurants as words.

What Spark gathers is one row a pair of context and word: its customers and tables. Pairs
seen once hold one table and are only counted; a sweep reseats the customers of every other
pair given the tables of its context and the word's probability in the parent, both joined
to the pair, and then the words in the parent. The number of tables is drawn from its
conditional (generalised Stirling numbers), for crowded dishes in blocks of an eighth. Totals
are summed after each sweep, and predictive probabilities, averaged over the last sweeps, use
these, so those of a context sum to one.

Scoring: the most frequent words and pairs (bounded tables) are broadcast and their tokens
are scored where the text is read; tokens of all others meet their row by shuffle joins,
counted per document first; pairs that were never seen get their context's weight times the
word's probability in the parent. Nothing is left out. Pairs are counted and looked up in
``PARTS`` parts by their hash, each a reading of the texts, so that one part's shuffle is on
disk at a time.

Defined cases: null and empty texts are one end token; a null id is trained on; repeated rows
count each; with no training rows every token is unknown; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import uuid
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import map_batches, mix, prepare, spread, texts_of, words_of
from joblattice.session import cut_lineage, release

HOT_WORDS = 1 << 16
#: Pairs broadcast for each word that is.
HOT_PAIRS = 16
#: Parts in which pairs are counted and looked up.
PARTS = 4
SWEEPS = 3
AVERAGED = 2
STRENGTH = 1.0
#: Customers of one dish that are seated together; more are reseated in blocks.
TOGETHER = 48

_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 5, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and context of every token (the end token included), tokens of each text.

    The context is the hash of the word before, ``_START`` for a text's first token.
    """
    words, counts = words_of(texts)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    token = np.empty(int(sizes.sum()), dtype=np.uint64)
    inside = np.ones(len(token), dtype=bool)
    inside[ends] = False
    token[inside] = words
    token[ends] = _END
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ends - sizes + 1] = _START
    return token, context, sizes


def _pair_key(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(token + mix(context + _ODD))


def _runs(texts: list[bytes], limit: int = 8 << 20):
    run, size = [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        yield run


def count_pairs(docs: DataFrame, text_col: str = "text", part: int = 0,
                parts: int = 1) -> DataFrame:
    """``u, w, n``: tokens by context and word, summed per run of texts before the shuffle."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "_text")
        found = []
        for run in _runs(texts):
            token, context, _ = tokens_of([texts[i] for i in run])
            key = _pair_key(token, context)
            mine = np.flatnonzero(key % np.uint64(parts) == part)
            _, first, n = np.unique(key[mine], return_index=True, return_counts=True)
            at = mine[first]
            found.append((context[at].view(np.int64), token[at].view(np.int64), n))
        u, w, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(n)],
                                          ["u", "w", "n"])
    rows = docs.select(F.col(text_col).alias("_text"))
    return map_batches(spread(rows), count, "u long, w long, n long")


# --- the sampler ------------------------------------------------------------------------

def log_stirling(d: float, size: int = TOGETHER) -> np.ndarray:
    """log of generalised Stirling numbers S_d(n, t) for n, t up to ``size``."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(size):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            stay = out[n, t] + np.log(np.maximum(n - d * t, 1e-300))
        out[n + 1, t] = np.logaddexp(out[n, t - 1], np.where(t <= n, stay, -np.inf))
    return out


def seat(n: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, strength: float,
         stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables drawn for dishes of ``n`` customers.

    ``base`` is the dish's probability in the parent, ``others`` the tables of the restaurant
    that serve other dishes. P(t) is proportional to S_d(n, t) base^t (strength + d others)
    (strength + d (others + 1)) ... over t factors.
    """
    tables = np.ones(len(n), dtype=np.int64)
    small = np.minimum(n, TOGETHER)
    for size in np.unique(small):
        if size < 2:
            continue
        rows = np.flatnonzero(small == size)
        t = np.arange(1, size + 1)
        rise = np.log(strength + d * (others[rows, None] + t - 1))
        weight = (stirling[size, t] + t * np.log(base[rows, None])
                  + np.cumsum(rise, axis=1))
        drawn = weight + rng.gumbel(size=weight.shape)
        tables[rows] = t[drawn.argmax(axis=1)]
    rows = np.flatnonzero(n > TOGETHER)
    seated = np.full(len(rows), TOGETHER, dtype=np.int64)
    while len(rows):                                # further customers in blocks of an eighth
        more = np.minimum(n[rows] - seated, np.maximum(seated // 8, 1))
        new = (strength + d * (others[rows] + tables[rows])) * base[rows]
        old = np.maximum(seated - d * tables[rows], 1e-9)
        tables[rows] += rng.binomial(more, new / (new + old))
        seated = seated + more
        left = seated < n[rows]
        rows, seated = rows[left], seated[left]
    return tables


class Totals:
    """Discounts, and the totals of the parent restaurant."""

    def __init__(self, d: float, d0: float, words: int, customers: int, tables: int,
                 strength: float = STRENGTH):
        self.d, self.d0, self.strength = d, d0, strength
        self.customers, self.tables = float(customers), float(tables)
        self.uniform = 1.0 / (words + 1)

    def root(self, c0: Column, t0: Column) -> Column:
        """Parent probability of a word with ``c0`` customers at ``t0`` tables there."""
        return ((c0 - F.lit(self.d0) * t0) / F.lit(self.strength + self.customers)
                + F.lit(self.unknown()))

    def unknown(self) -> float:
        """Parent probability of a word that nobody has."""
        return ((self.strength + self.d0 * self.tables) * self.uniform
                / (self.strength + self.customers))

    def back(self, customers: Column, tables: Column) -> Column:
        """Weight of the parent in a context."""
        return (F.lit(self.strength) + F.lit(self.d) * tables) / (F.lit(self.strength) + customers)


def _seats(totals: Totals, number: int, seed: int, pairs: bool):
    """Function of a batch that draws new tables ``t`` from ``n, t, base, others``."""
    d = totals.d if pairs else totals.d0
    stirling = log_stirling(d)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = batch.column("w").to_numpy()
        n, t, base, others = (batch.column(x).to_numpy() for x in ("n", "t", "base", "others"))
        rng = np.random.Generator(np.random.PCG64(
            [seed, number, int(pairs), int(w[0]) & 0xFFFFFFFF, len(w)]))
        t = seat(n, base, np.maximum(others - t, 0), d, totals.strength, stirling, rng)
        kept = [c for c in batch.schema.names if c not in ("t", "base", "others")]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(t)], [*kept, "t"])
    return run


def _reseat(rows: DataFrame, totals: Totals, number: int, seed: int, pairs: bool) -> DataFrame:
    """``rows`` with new ``t``; sorted, so that the draws do not follow the shuffle's order."""
    keys = ["u", "w"] if pairs else ["w"]
    kept = [f for f in rows.schema.fields if f.name not in ("t", "base", "others")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", t long"
    return map_batches(rows.sortWithinPartitions(*keys),
                       _seats(totals, number, seed, pairs), schema)


class State:
    """Seating of all tokens.

    ``pairs`` are the rows ``u, w, n, t, part`` of pairs seen more than once, ``words`` are rows
    ``w, c, ones, n, t`` (tokens, pairs seen once, customers and tables in the parent) and
    ``contexts`` rows ``u, c, ones, tables``. A kept sweep adds a column to each: tables
    ``s0, s1, ...``, parent probabilities ``r0, ...`` and weights of the parent ``b0, ...``.
    """

    def __init__(self, pairs: DataFrame, words: DataFrame, contexts: DataFrame):
        self.pairs, self.words, self.contexts = pairs, words, contexts

    def totals(self, d: float, d0: float, vocabulary: int) -> Totals:
        row = self.words.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
        return Totals(d, d0, vocabulary, row["n"] or 0, row["t"] or 0)


def sweep(state: State, totals: Totals, number: int, seed: int = 17) -> State:
    """One Gibbs sweep: pairs given contexts and parent, then words in the parent."""
    before = state
    seated = (state.pairs
              .join(state.words.select("w", totals.root(F.col("n"), F.col("t")).alias("base")), "w")
              .join(state.contexts.select("u", F.col("tables").alias("others")), "u"))
    pairs = cut_lineage(_reseat(seated, totals, number, seed, True))

    def tables(key: str) -> DataFrame:
        return pairs.groupBy(key).agg(F.sum("t").alias("_more"))
    now = F.col("ones") + F.coalesce("_more", F.lit(0))
    contexts = cut_lineage(state.contexts.join(tables("u"), "u", "left")
                           .withColumn("tables", now).drop("_more"))
    served = (state.words.join(tables("w"), "w", "left").withColumn("n", now).drop("_more")
              .withColumns({"base": F.lit(totals.uniform),
                            "others": F.lit(int(totals.tables)).cast("long")}))
    words = cut_lineage(_reseat(served, totals, number, seed, False))
    for old in (before.pairs, before.words, before.contexts):
        release(old)
    return State(pairs, words, contexts)


class Model:
    """Averaged probabilities of pairs, and what unseen pairs are scored from.

    ``pairs`` are tables ``u, w, n, p`` by part, ``p`` summed over the kept sweeps; ``vocabulary_rows``
    are rows ``w, c, r0, ...`` and ``contexts`` rows ``u, b0, ...``.
    """

    def __init__(self, pairs: list[DataFrame], vocabulary_rows: DataFrame, contexts: DataFrame,
                 unknown: list[float], tokens: int, vocabulary: int):
        self.pairs, self.vocabulary_rows, self.contexts = pairs, vocabulary_rows, contexts
        self.unknown, self.tokens, self.vocabulary = unknown, tokens, vocabulary

    @property
    def words(self) -> DataFrame:
        """One row a word, with its contexts ``g`` and their ``p``: to look at, not used in scoring."""
        lists = _union(self.pairs).groupBy("w").agg(F.collect_list(F.struct("u", "p")).alias("e"))
        return self.vocabulary_rows.join(lists, "w").select(
            "w", "c", F.col("e.u").alias("g"),
            F.array(*[f"r{i}" for i in range(len(self.unknown))]).alias("pr"),
            F.col("e.p").alias("p"))

    @cached_property
    def back(self) -> list[dict[int, float]]:
        """Weight of the parent by kept sweep and context, as ``words`` for small models only."""
        rows = self.contexts.collect()
        return [{r["u"]: r[f"b{i}"] for r in rows} for i in range(len(self.unknown))]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def train(docs: DataFrame, text_col: str = "text", sweeps: int = SWEEPS,
          averaged: int = AVERAGED, parts: int = PARTS) -> Model:
    """Sample the seating of all tokens of ``docs`` and average the last sweeps."""
    prepare(docs.sparkSession)
    counted = [cut_lineage(count_pairs(docs, text_col, i, parts).repartition("u", "w")
                           .groupBy("u", "w").agg(F.sum("n").alias("n"))) for i in range(parts)]
    pairs = _union([x.withColumn("part", F.lit(i)) for i, x in enumerate(counted)])
    once, one = F.count_if(F.col("n") == 1), F.lit(1).cast("long")
    words = cut_lineage(pairs.groupBy("w").agg(
        F.sum("n").alias("c"), once.alias("ones"), F.count_if(F.col("n") == 2).alias("twos"),
        F.count(F.lit(1)).alias("n")).withColumn("t", one))
    row = words.agg(F.count("*").alias("v"), F.sum("c").alias("tokens"),
                    F.sum("ones").alias("a1"), F.sum("twos").alias("a2"),
                    F.count_if(F.col("n") == 1).alias("b1"),
                    F.count_if(F.col("n") == 2).alias("b2")).first()

    def discount(n1, n2) -> float:
        return min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 else 0.5
    d, d0 = discount(row["a1"], row["a2"]), discount(row["b1"], row["b2"])
    state = State(cut_lineage(pairs.where("n > 1").withColumn("t", one)), words.drop("twos"),
                  cut_lineage(pairs.groupBy("u").agg(F.sum("n").alias("c"), once.alias("ones"),
                                                     F.count(F.lit(1)).alias("tables"))))
    totals = state.totals(d, d0, row["v"])
    unknown: list[float] = []
    for number in range(sweeps):
        state = sweep(state, totals, number)
        totals = state.totals(d, d0, row["v"])
        if number >= sweeps - averaged:
            i = len(unknown)
            unknown.append(totals.unknown())
            state = State(
                state.pairs.withColumn(f"s{i}", F.col("t")),
                state.words.withColumn(f"r{i}", totals.root(F.col("n"), F.col("t"))),
                state.contexts.withColumn(f"b{i}", totals.back(F.col("c"), F.col("tables"))))
    kept = range(len(unknown))
    own = sum(((F.col("n") - F.lit(d) * F.col(f"s{i}")) / (F.lit(totals.strength) + F.col("c"))
               + F.col(f"b{i}") * F.col(f"r{i}") for i in kept), F.lit(0.0))
    found = []
    for i, part in enumerate(counted):
        alone = part.where("n = 1").select("u", "w", "n", *[one.alias(f"s{k}") for k in kept])
        rows = alone.unionByName(state.pairs.where(F.col("part") == i).select(alone.columns))
        found.append(cut_lineage(
            rows.join(state.words.select("w", *[f"r{k}" for k in kept]), "w")
            .join(state.contexts.select("u", "c", *[f"b{k}" for k in kept]), "u")
            .select("u", "w", "n", own.cast("float").alias("p"))))
        release(part)
    words = cut_lineage(state.words.select("w", "c", *[f"r{k}" for k in kept]))
    contexts = cut_lineage(state.contexts.select("u", *[f"b{k}" for k in kept]))
    for old in (state.pairs, state.words, state.contexts):
        release(old)
    return Model(found, words, contexts, unknown, int(row["tokens"] or 0), int(row["v"]))


# --- scoring ----------------------------------------------------------------------------

_HOT: dict[str, dict] = {}


def _hot_tables(key: str, held) -> dict:
    """Sorted hot words and pairs with their logarithms, built once a worker."""
    if key not in _HOT:
        _HOT.clear()
        m = held.value
        pair = _pair_key(m["pair_w"].view(np.uint64), m["pair_u"].view(np.uint64))
        order, by_pair = np.argsort(m["w"]), np.argsort(pair)
        _HOT[key] = {"w": m["w"][order], "base": m["base"][order],
                     "pair": pair[by_pair], "log": m["log"][by_pair]}
    return _HOT[key]


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _document_counts(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of every distinct pair of document and key."""
    both = mix(keys + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, first, n = np.unique(both, return_index=True, return_counts=True)
    return first, n


def _commonest(rows: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows of the largest counts, as many whole counts as give ``limit`` rows at most."""
    least, room = None, limit
    by_count = rows.groupBy(count).agg(F.count(F.lit(1)).alias("rows"))
    for r in by_count.orderBy(F.col(count).desc()).collect():      # a row a count that occurs
        if r["rows"] > room:
            break
        least, room = r[count], room - r["rows"]
    return rows.where(F.col(count) >= F.lit(least))


def _word_rows(rows: DataFrame, key: str, held) -> DataFrame:
    """A row a document (``cold`` is false) with the sums over hot words, and its cold words."""
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hot = _hot_tables(key, held)
        texts = texts_of(batch, "_text")
        out: list[list[np.ndarray]] = []
        for part in _runs(texts):
            token, _, sizes = tokens_of([texts[i] for i in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            unique, inverse = np.unique(token.view(np.int64), return_inverse=True)
            at, there = _found(hot["w"], unique)
            is_hot, number = there[inverse], np.array(part)
            here = np.bincount(doc[is_hot], minlength=len(part))
            base = np.bincount(doc[is_hot], hot["base"][at[inverse][is_hot]], len(part))
            out.append([number, np.zeros(len(part), bool), np.zeros(len(part), np.int64), sizes,
                        here, base])
            cold = np.flatnonzero(~is_hot)
            first, n = _document_counts(doc[cold], token[cold])
            first = cold[first]
            out.append([number[doc[first]], np.ones(len(n), bool), token[first].view(np.int64), n,
                        np.zeros(len(n), np.int64), np.zeros(len(n))])
        if not out:
            return None
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("_key").take(pa.array(cols[0])),
             batch.column("_id").take(pa.array(cols[0])), *[pa.array(x) for x in cols[1:]]],
            ["_key", "_id", "cold", "w", "n", "known", "base"])
    return map_batches(rows, run, f"_key long, _id {id_type}, cold boolean, w long, n long, "
                                  "known long, base double")


def _pair_rows(rows: DataFrame, key: str, held, part: int, parts: int) -> DataFrame:
    """Pairs of one part that are not hot, and the sums over its hot ones in rows with ``n`` 0.

    The latter carry the document's key for ``u``: they match no pair, wherever they are sent.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hot = _hot_tables(key, held)
        texts = texts_of(batch, "_text")
        ids = batch.column("_key").to_numpy()
        out: list[list[np.ndarray]] = []
        for some in _runs(texts):
            token, context, sizes = tokens_of([texts[i] for i in some])
            pair = _pair_key(token, context)
            mine = np.flatnonzero(pair % np.uint64(parts) == part)
            doc = np.repeat(np.arange(len(some)), sizes)[mine]
            number = ids[some]
            first, n = _document_counts(doc, pair[mine])
            at, there = _found(hot["pair"], pair[mine][first])
            d = doc[first][there]
            logs = np.bincount(d, n[there] * hot["log"][at[there]], len(some))
            out.append([number, number, np.zeros(len(some), np.int64),
                        np.zeros(len(some), np.int64), logs])
            first, n = first[~there], n[~there]
            at = mine[first]
            out.append([number[doc[first]], context[at].view(np.int64), token[at].view(np.int64),
                        n, np.zeros(len(n))])
        if not out:
            return None
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols],
                                          ["_key", "u", "w", "n", "s"])
    return map_batches(rows, run, "_key long, u long, w long, n long, s double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          hot_words: int = HOT_WORDS) -> DataFrame:
    """``_id, n_tokens, n_known, base_score, score`` of every row.

    Rows are known by a hash of id and text; what equal rows add up to is shared among them.
    """
    spark = docs.sparkSession
    prepare(spark)
    floor = model.tokens + 0.5 * (model.vocabulary + 1)
    kept, parts = range(len(model.unknown)), len(model.pairs)
    table = _commonest(model.vocabulary_rows.select("w", "c"), "c", hot_words).toArrow()
    pairs = _commonest(_union(model.pairs), "n", HOT_PAIRS * hot_words).select(
        "u", "w", "p").toArrow()
    m = {"w": table["w"].to_numpy(), "base": np.log10((table["c"].to_numpy() + 0.5) / floor),
         "pair_u": pairs["u"].to_numpy(), "pair_w": pairs["w"].to_numpy(),
         "log": np.log10(pairs["p"].to_numpy() / max(len(kept), 1))}
    key, held = uuid.uuid4().hex, spark.sparkContext.broadcast(m)
    rows = spread(docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key")))
    # Words: all tokens of a document, the known ones and the base score.
    seen = cut_lineage(_word_rows(rows, key, held))
    cold = (seen.where("cold").select("_key", "w", "n")
            .join(model.vocabulary_rows.select("w", "c"), "w", "left")
            .groupBy("_key").agg(
                F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known2"),
                F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(floor)))
                .alias("base2")))
    # Pairs: those found add to their document's sum, the others stay as rows.
    log = F.col("n") * F.log10(F.col("p") / F.lit(float(len(kept))))
    unseen = F.col("p").isNull() & (F.col("n") > 0)
    summed = _union([cut_lineage(
        _pair_rows(rows, key, held, i, parts)
        .join(model.pairs[i].select("u", "w", "p"), ["u", "w"], "left")
        .select("_key", *[F.when(unseen, F.col(c)).alias(c) for c in ("u", "w")], "n",
                F.coalesce(F.when(F.col("n") > 0, log), "s").alias("s"))
        .groupBy("_key", "u", "w").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
        for i in range(parts)])
    parent = sum((F.coalesce(f"b{i}", F.lit(1.0)) * F.coalesce(f"r{i}", F.lit(model.unknown[i]))
                  for i in kept), F.lit(0.0))
    rest = (summed.where("u is not null").select("_key", "u", "w", "n")
            .join(model.vocabulary_rows.drop("c"), "w", "left").join(model.contexts, "u", "left")
            .withColumn("p", parent).select("_key", log.alias("s")))
    sums = summed.where("u is null").select("_key", "s").unionByName(rest).groupBy("_key").agg(
        F.sum("s").alias("score"))
    own = seen.where("not cold")
    copies = own.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"))
    zero = F.lit(0)
    return (own.join(copies, "_key").join(cold, "_key", "left").join(sums, "_key").select(
        "_id", F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", zero) / F.col("copies")).cast("long")
        .alias("n_known"),
        (F.col("base") + F.coalesce("base2", zero) / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score")))


def perplexity(score_col: Column, tokens: Column) -> Column:
    """Perplexity per token of a log10 score."""
    return F.pow(F.lit(10.0), -score_col / tokens)
