"""Compare every registered query with its SQL on one data set.

usage: python check_oracles.py [sf_dir] [name-part ...]
"""

import math
import os
import sys
import time

import duckdb

from docgauge.plans import load
from docgauge.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in value.items()) + "}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def check(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return f"ROWS {len(got):7d} {took:6.1f}s {name}"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [(c, types.get(c), str(t)) for c, t in zip(rel.columns, rel.types) if pairs.get(types.get(c), str(t)) != str(t)]
    if sorted(df.columns) != sorted(rel.columns):
        return f"COLS {name} {sorted(df.columns)} {sorted(rel.columns)}"
    if got != want:
        only = [(g, w) for g, w in zip(got, want) if g != w][:2]
        missing = list(set(want) - set(got))[:2], list(set(got) - set(want))[:2]
        return f"DIFF {name} rows {len(got)}/{len(want)} first {str(only)[:600]} want-got {str(missing)[:900]}"
    return f"OK   {len(got):7d} {took:6.1f}s {name} {odd or ''}"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    catalog = load()
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if len(sys.argv) > 2 and not any(part in name for part in sys.argv[2:]):
            continue
        try:
            line = check(spark, con, name, fn, catalog.ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            line = f"FAIL {name} {type(e).__name__} {str(e)[:700]}"
        bad += not line.startswith(("OK", "ROWS"))
        print(line, flush=True)
    print("not matching:", bad)


if __name__ == "__main__":
    main()
