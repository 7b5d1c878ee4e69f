"""Runs registered queries next to their SQL and compares rows.

    python tests/compare.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if hasattr(value, "item"):
        return _cell(value.item())
    return value


def _rows(frame):
    columns = sorted(frame.columns)
    data = [[_cell(v) for v in frame[c].tolist()] for c in columns]
    return columns, sorted(zip(*data), key=repr)


def compare(spark_frame, duck_frame):
    """None if equal, else what differs."""
    left_columns, left = _rows(spark_frame)
    right_columns, right = _rows(duck_frame)
    if left_columns != right_columns:
        return f"columns {left_columns} / {right_columns}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if repr(a) != repr(b):
            return f"row {str(a)[:600]} / {str(b)[:600]}"
    return None


def check(spark, con, sf_dir, name, queries, oracles):
    start = time.time()
    frame = queries[name](spark, sf_dir)
    got = frame.toPandas()
    spark_time = time.time() - start
    if name not in oracles:
        return f"{len(got)} rows", spark_time, 0.0, True
    start = time.time()
    expected = con.execute(oracles[name]).df()
    duck_time = time.time() - start
    types = [t for _, t in frame.dtypes if t.startswith(("array", "map", "struct"))]
    difference = compare(got, expected)
    kinds = [(c, str(a), str(b)) for c, a, b in ((c, got[c].dtype, expected[c].dtype) for c in got.columns if c in expected) if a != b]
    note = f" types {kinds}" if kinds else ""
    return (difference or f"ok {len(got)}") + (f" nested {types}" if types else "") + note, spark_time, duck_time, difference is None


def main():
    from tagloom.catalog import ORACLES, QUERIES
    from tagloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    names = [q for n in names for q in QUERIES if q == n or (n.endswith("*") and q.startswith(n[:-1]))]
    spark = build_session("compare")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            text, a, b, ok = check(spark, con, sf_dir, name, QUERIES, ORACLES)
        except Exception as error:
            text, a, b, ok = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0, 0, False
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:34s} {a:6.2f} {b:6.2f} {text}", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
