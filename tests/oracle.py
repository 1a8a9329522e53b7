"""Side-by-side check of registered queries against DuckDB.

python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""
from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf.notna(), None)
    key = pdf.apply(lambda r: "\x01".join("~" if v is None else (f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r), axis=1) if len(pdf) else pd.Series([], dtype=str)
    return pdf.iloc[key.argsort(kind="stable")].reset_index(drop=True) if len(pdf) else pdf


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    exact = near = 0
    first = None
    for c in a.columns:
        for k, (x, y) in enumerate(zip(a[c], b[c])):
            if x is None and y is None:
                continue
            if x is None or y is None or x != y:
                if isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y)):
                    near += 1
                    continue
                exact += 1
                first = first or (c, k, x, y)
    if exact:
        return f"{exact} values differ, first {first}"
    return f"NEAR {near} values off by rounding" if near else None


def main() -> None:
    from graticule.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "0.01"
    names = [a for k, a in enumerate(args) if not a.startswith("--") and (k == 0 or args[k - 1] != "--sf")]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session()
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            t0 = time.time()
            got = fn(spark, folder).toPandas()
            t1 = time.time()
            note = None
            if name in oracle:
                note = differences(got, con.execute(oracle[name]).df())
            t2 = time.time()
            bad += bool(note)
            print(f"{'FAIL' if note else 'ok  '} {name} rows={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s {'' if name in oracle else 'NO-ORACLE '}{note or ''}", flush=True)
            spark.catalog.clearCache()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name} {type(e).__name__}: {str(e)[:300]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
