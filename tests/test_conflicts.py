"""First-come-first-served inserts under two unique keys, against the plain loop."""

import random

import pytest

from joblattice.operators import merge as M

SCHEMA = "seq long, key string, source string, external_id string"


def loop(rows):
    keys, ends, out = set(), set(), []
    for seq, key, source, ext in sorted(rows):
        end = None if source is None or ext is None else (source, ext)
        if key not in keys and (end is None or end not in ends):
            keys.add(key)
            ends.add(end)
            out.append((key, seq))
    return sorted(out)


def accepted(spark, rows, most):
    got = M._accepted(spark.createDataFrame(rows, SCHEMA), most).select("key", "seq").collect()
    return sorted(map(tuple, got))


def chain(n, start=0):
    """Every row shares its hash or its id with the one before."""
    return [(start + i, f"h{start}-{(i + 1) // 2}", "s", f"e{start}-{i // 2}") for i in range(n)]


def tangle(n, ends, seed):
    rng = random.Random(seed)
    return [(i, f"h{rng.randrange(ends)}", rng.choice(["s", "s", "t", None]),
             rng.choice([None, *[f"e{rng.randrange(ends)}"] * 9])) for i in range(n)]


@pytest.mark.parametrize("most", [M.SETTLED_ROWS, 3])
@pytest.mark.parametrize("rows", [
    [], chain(7), chain(40) + chain(41, 1_000), [(i, f"h{i}", "s", "hot") for i in range(60)],
    tangle(200, 40, 1), tangle(300, 150, 2), tangle(120, 5, 3),
    [(0, "a", None, "x"), (1, "b", None, "x"), (2, "c", "s", None), (3, "d", "s", None)]])
def test_conflicts_by_the_plain_loop(spark, rows, most):
    assert accepted(spark, rows, most) == loop(rows)


@pytest.fixture
def tables(monkeypatch):
    count = []
    real = M.cut_lineage

    def counted(df):
        count.append(1)
        return real(df)
    monkeypatch.setattr(M, "cut_lineage", counted)
    return count


def test_long_chains_write_a_constant_number_of_tables(spark, tables):
    rng = random.Random(4)
    for n in (10, 1_000):
        tables.clear()
        rows = chain(n)
        rng.shuffle(rows)
        assert accepted(spark, rows, M.SETTLED_ROWS) == loop(rows)
        assert len(tables) == 3


def test_chains_beyond_one_task_take_a_logarithmic_number(spark, tables):
    rows = chain(1_000)
    assert accepted(spark, rows, 100) == loop(rows)
    assert len(tables) < 20
