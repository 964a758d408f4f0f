"""Runs queries beside their SQL twins: python tests/compare.py FOLDER [NAME...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder: str):
    """A DuckDB connection with a view per table of a data folder."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}/*.parquet" if os.path.isdir(f"{folder}/{name}") else f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    """One form for values of both engines."""
    import datetime as dt
    import decimal
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def compare(df, con, sql: str):
    """(rows, rows of the twin, differing rows, a few of them, column problem)."""
    rel = con.sql(sql)
    cols, other = sorted(df.columns), sorted(rel.columns)
    if cols != other:
        return 0, 0, -1, (cols, other), None
    from collections import Counter

    a = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    b = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    types = {c: (dict(df.dtypes)[c], str(rel.types[rel.columns.index(c)])) for c in cols}
    return sum(a.values()), sum(b.values()), sum(((a - b) + (b - a)).values()), (list((a - b).items())[:3], list((b - a).items())[:3]), types


if __name__ == "__main__":
    from siltstone import session

    import __spark_entry__ as entry

    spark = session.build("local[8]", "compare")
    folder, names = sys.argv[1], sys.argv[2:]
    con = views(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            if name in oracle:
                n, m, d, sample, types = compare(queries[name](spark, folder), con, oracle[name])
                print(f"{'OK  ' if d == 0 else 'DIFF'} {name}: {n} {m} differing {d} {time.time() - t:.1f}s", "" if d == 0 else (sample, types), flush=True)
            else:
                print(f"rows {name}: {queries[name](spark, folder).count()} {time.time() - t:.1f}s", flush=True)
        except Exception as e:
            print(f"FAIL {name}: {str(e)[:900]}", flush=True)
