"""Run every registered query next to its DuckDB oracle and compare.

    python tests/oracle_check.py [sf_dir] [key-substring ...]

Compares row count, column names and an order-insensitive multiset of rows
(doubles rounded to 6 decimals, timestamps as text).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (pd.Timestamp,)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (bool,)):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item())
    except Exception:
        pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(sp: pd.DataFrame, od: pd.DataFrame) -> tuple[bool, str]:
    if sorted(sp.columns) != sorted(od.columns):
        return False, f"columns {sorted(sp.columns)} vs {sorted(od.columns)}"
    if len(sp) != len(od):
        return False, f"rows {len(sp)} vs {len(od)}"
    a, b = rows(sp), rows(od)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} differing rows, e.g. {bad[0]}"
    return True, f"{len(sp)} rows"


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from sensorlake.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    fails = 0
    for k, fn in qs.items():
        if pats and not any(p in k for p in pats):
            continue
        t0 = time.time()
        try:
            sp = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:300]}")
            fails += 1
            continue
        t1 = time.time()
        if k not in sqls:
            print(f"ROWS {k}: {len(sp)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            od = con.execute(sqls[k]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:300]}")
            fails += 1
            continue
        ok, msg = compare(sp, od)
        print(f"{'OK  ' if ok else 'FAIL'} {k}: {msg} {t1 - t0:.1f}s")
        fails += 0 if ok else 1
    print(f"{fails} failures")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
