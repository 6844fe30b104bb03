"""Run registered queries against their oracles on one scale factor.

Usage: python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(t: str) -> str:
    t = t.lower()
    if "int" in t or t == "long":
        return "int"
    if t.startswith(("varchar", "string")):
        return "str"
    if t.startswith(("double", "float", "decimal")):
        return "num"
    return t


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    return cols, {c: kind(t) for c, t in df.dtypes}, sorted(rows, key=repr)


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    types = {x[0]: kind(str(x[1])) for x in rel.description}
    cols = sorted(names)
    order = [names.index(c) for c in cols]
    rows = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    return cols, types, sorted(rows, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    cols, types, rows = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return "rows-only", len(rows), ""
    ocols, otypes, orows = duck_rows(con, sql)
    if cols != ocols:
        return "FAIL", len(rows), f"columns {cols} vs {ocols}"
    bad = {c: (types[c], otypes[c]) for c in cols if types[c] != otypes[c]}
    if bad:
        return "FAIL", len(rows), f"types {bad}"
    if rows != orows:
        mine, theirs = set(rows) - set(orows), set(orows) - set(rows)
        return "FAIL", len(rows), (f"{len(rows)} vs {len(orows)} rows; spark only "
                                   f"{[str(r)[:600] for r in sorted(mine, key=repr)[:2]]} duck only "
                                   f"{[str(r)[:600] for r in sorted(theirs, key=repr)[:2]]}")
    return ("ok" if rows else "EMPTY"), len(rows), ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    tally: dict[str, int] = {}
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            status, n, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:
            status, n, note = "ERROR", 0, str(exc)[:900]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        tally[status] = tally.get(status, 0) + 1
        print(f"{status:9} {name:34} rows={n:<7} {time.time() - start:6.2f}s {note}", flush=True)
    print(tally)
    spark.stop()


if __name__ == "__main__":
    main()
