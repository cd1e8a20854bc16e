"""Holds queries against their SQL: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _key(row):
    return tuple((x is None, "nan" if isinstance(x, float) and math.isnan(x) else str(x) if not isinstance(x, float) else f"{x:.9g}") for x in row)


def differs(spark, con, query, sql: str, sf_dir: str) -> str:
    """What differs between a query's rows and those of its SQL, as a text; empty if nothing does."""
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*names).collect()]
    want = con.execute(sql)
    have = [d[0] for d in want.description]
    if sorted(have) != names:
        return f"columns {names}, SQL {sorted(have)}"
    other = [tuple(r[have.index(n)] for n in names) for r in want.fetchall()]
    a, b = sorted(map(_key, rows)), sorted(map(_key, other))
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} rows, SQL {len(b)}; first difference {first}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from textloom.session import build_session

    spark, con = build_session(), duck(sys.argv[1])
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            said = differs(spark, con, queries[name], oracle[name], sys.argv[1]) if name in oracle else f"no SQL, {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # report and go on to the next query
            said = f"{type(e).__name__} {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
