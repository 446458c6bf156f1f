"""Run registered queries beside their SQL in DuckDB and report differences.

python tools/compare.py [--sf 0.01] [name prefix ...]
"""
from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from fieldrounds.plans import ORACLES, QUERIES  # noqa: E402
from fieldrounds.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].map(lambda v: isinstance(v, (list, dict)) or hasattr(v, "tolist") and getattr(v, "ndim", 0) > 0).any():
            df[c] = df[c].map(lambda v: str(list(v)) if v is not None and not isinstance(v, float) else None)
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT else v)
        num = df[c].map(lambda v: v is None or (isinstance(v, (int, float)) and not isinstance(v, bool)) or hasattr(v, "dtype")).all()
        df[c] = df[c].map(lambda v: None if v is None else (repr(float(v)) if num else str(v)))
    return df.fillna("~").sort_values(list(df.columns), kind="stable").reset_index(drop=True) if len(df.columns) else df


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    x, y = plain(a), plain(b)
    bad = (x != y).any(axis=1)
    if bad.any():
        i = bad[bad].index[:3]
        cols = [c for c in x.columns if (x[c] != y[c]).any()]
        return f"{int(bad.sum())} rows differ in {cols}:\n{x.loc[i].to_string()}\n--\n{y.loc[i].to_string()}"
    return ""


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--list", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    names = [n for n in QUERIES if not a.names or any(n.startswith(p) for p in a.names)]
    if a.list:
        print("\n".join(names))
        return 0
    spark = local_session()
    sf_dir = f"/root/testdata/sf{a.sf}"
    con, bad, unchecked = duck(sf_dir), [], []
    for n in names:
        t = time.time()
        try:
            got = QUERIES[n](spark, sf_dir).toPandas()
            took = time.time() - t
            if n not in ORACLES:
                unchecked.append(n)
                print(f"rows-only {n:38s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            t = time.time()
            want = con.execute(ORACLES[n]).df()
            msg = compare(got, want)
        except Exception as e:  # noqa: BLE001
            msg, got, took = f"{type(e).__name__}: {str(e)[:1500]}", [], time.time() - t
            if "FATAL" in msg or "INTERNAL" in msg:
                con = duck(sf_dir)
        print(f"{'ok  ' if not msg else 'FAIL'} {n:42s} {len(got):7d} rows {took:6.2f}s  sql {time.time() - t:5.2f}s", flush=True)
        if msg:
            bad.append(n)
            print("   ", msg, flush=True)
    print(f"{len(names) - len(bad) - len(unchecked)} match, {len(unchecked)} without SQL, {len(bad)} failed: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
