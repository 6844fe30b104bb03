import pytest


@pytest.fixture
def documents(spark):
    """documents(rows): rows of (doc_id, text) with columns whose names may clash."""
    def make(rows, **extra):
        full = [(i, t, None, None, 7, "x", "y") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, "
            "`_id` string, `count` string")
    return make


@pytest.fixture
def as_dict():
    def run(df, key="_id"):
        rows = df.collect()
        out = {r[key]: r for r in rows}
        assert len(out) == len(rows)
        return out
    return run
