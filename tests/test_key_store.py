"""Key table of the store: what a batch reads, and that it finds all it needs."""

import random
import re

from pyspark.sql import functions as F

from joblattice.operators.merge import resolve_batch
from joblattice.session import new_folder
from joblattice.sources.key_store import KeyStore, listing_keys

SCHEMA = "seq long, dedup_hash string, source string, external_id string, date_scraped timestamp"


def rows(spark, keys):
    return spark.createDataFrame([(i, h, s, e, None) for i, (h, s, e) in enumerate(keys)], SCHEMA)


def many(n, seed, ends=10_000):
    rng = random.Random(seed)
    return [(rng.choice([f"h{rng.randrange(ends)}"] * 9 + [None, ""]),
             rng.choice(["s", "long source", None]),
             rng.choice([f"e:{rng.randrange(ends)}"] * 9 + [None, ""])) for _ in range(n)]


def known(found):
    got = [tuple(r) for r in found.select("dedup_hash", "source", "external_id").collect()]
    return ({h for h, _, _ in got if h is not None}, {(s, e) for _, s, e in got if e is not None})


def test_lookup_finds_exactly_the_shared_keys(spark):
    store = KeyStore(spark, new_folder(spark, "keys"), parts=16, bitmaps=1)
    base, first, second = many(3_000, 1), many(400, 2), many(300, 3)
    store.ensure_base(rows(spark, base))
    store.append(rows(spark, first), "a", 0)
    store.append(rows(spark, first[:9] + second[:100]), "b", 0)
    batch = rows(spark, second)
    for before, held in (((None), base + first + second[:100]), (("b", 0), base + first),
                         (("a", 0), base + first[:9] + second[:100])):
        hashes = {h for h, _, _ in held if h} & {h for h, _, _ in second}
        pairs = {(s, e) for _, s, e in held if s is not None and e is not None}
        pairs &= {(s, e) for _, s, e in second}
        assert known(store.lookup(batch, before)) == (hashes, pairs)


def test_a_batch_is_resolved_as_from_the_whole_store(spark):
    store = KeyStore(spark, new_folder(spark, "keys"), parts=16)
    base = rows(spark, many(2_000, 4))
    batch = rows(spark, many(500, 5)).withColumn("date_scraped", F.current_timestamp())
    store.ensure_base(base)
    whole, part = (sorted(map(tuple, resolve_batch(s, batch).labels.collect())) for s in (
        base, store.lookup(batch)))
    assert part == whole and len({r[2] for r in whole}) == 3


def parts_read(store, batch):
    """(result, folders of the base that its scan keeps rows of, and the scan's filters)."""
    scans = []
    real = store.stored

    def spy(where, before=None):
        out = real(where, before)
        scans.append(out)
        return out
    store.stored = spy
    found = store.lookup(batch)
    (scan,) = scans
    files = [r[0] for r in scan.select(F.input_file_name()).distinct().collect()]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    return found, {m.groups() for m in (re.search(r"kind=(\w+)/part=(\d+)", f) for f in files) if m}, plan


def test_a_batch_reads_only_the_parts_its_keys_may_be_in(spark):
    store = KeyStore(spark, new_folder(spark, "keys"), parts=64)
    base = [(f"h{i}", "s", f"e{i}") for i in range(2_000)]
    store.ensure_base(rows(spark, base))
    found, folders, plan = parts_read(store, rows(spark, [
        base[5], base[700], *[(f"n{i}", "s", f"n{i}") for i in range(300)]]))
    want = {(r["kind"], str(r["part"])) for r in store._placed(
        listing_keys(rows(spark, [base[5], base[700]]))).collect()}
    assert want <= folders and len(folders) <= len(want) + 6      # of 128 folders
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "part#" in filters and "kind#" in filters
    assert known(found) == ({"h5", "h700"}, {("s", "e5"), ("s", "e700")})


def test_new_keys_read_nothing_of_the_store(spark):
    store = KeyStore(spark, new_folder(spark, "keys"), parts=64)
    store.ensure_base(rows(spark, [(f"h{i}", "s", f"e{i}") for i in range(500)]))
    found, folders, _ = parts_read(store, rows(spark, [(f"new{i}", "t", f"n{i}")
                                                       for i in range(5)]))
    assert len(folders) <= 2
    assert found.count() == 0


def test_base_is_laid_out_once_and_a_replayed_batch_replaces_its_keys(spark):
    store = KeyStore(spark, new_folder(spark, "keys"), parts=4)
    store.ensure_base(rows(spark, [("h1", "s", "1")]))
    store.ensure_base(rows(spark, [("h2", "s", "2")]))
    store.append(rows(spark, [("h3", "s", "3")]), "a", 0)
    store.append(rows(spark, [("h4", "s", "4")]), "a", 0)
    batch = rows(spark, [(f"h{i}", "s", str(i)) for i in range(1, 5)])
    assert known(store.lookup(batch)) == ({"h1", "h4"}, {("s", "1"), ("s", "4")})


def test_empty_store_and_empty_batch(spark):
    store = KeyStore(spark, new_folder(spark, "keys"), parts=4)
    assert store.lookup(rows(spark, [("h", "s", "e")])).count() == 0
    store.ensure_base(rows(spark, []))
    assert store.lookup(rows(spark, [("h", "s", "e")])).count() == 0
    assert store.lookup(rows(spark, [])).count() == 0
