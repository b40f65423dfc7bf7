"""Run registered queries against their SQL in DuckDB and compare the values."""

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
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    import numpy as np

    if v is None or v is getattr(__import__("pandas"), "NA"):
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(records, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    rows = [tuple(plain(r[i]) for i in at) for r in records]
    return order, sorted(rows, key=lambda r: tuple(repr(x) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty string when equal, otherwise what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want_cols, want = rows_of(rel.fetchall(), cols)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(got_cols, a))} != {dict(zip(got_cols, b))}"
    return ""


def main(names):
    from lexatlas.plans import catalog
    from lexatlas.session import build_session

    catalog.load()
    spark = build_session("compare", "8", 8)
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = duck(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in catalog.SQL:
                verdict = compare(spark, con, name, fn, catalog.SQL[name], sf_dir) or "equal"
            else:
                verdict = f"rows only: {len(fn(spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        flag = "" if verdict == "equal" or verdict.startswith("rows only") else "  <<<<"
        bad += bool(flag)
        print(f"{name:34s} {time.time() - start:6.1f}s  {verdict}{flag}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
