"""Run registered queries in Spark and their SQL in DuckDB; compare results.

    python tools/oracle_check.py [--sf DIR] [name ...]

Comparison: row count, column names, and an order-insensitive hash of the
values with columns sorted by name (what the driver's correctness gate does).
"""

from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _cell(v):
    if v is None or v is pd.NA:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _cell(v.tolist())
    return str(v)


def frame_hash(df: pd.DataFrame) -> tuple[int, list[str], str, list[str]]:
    cols = sorted(df.columns)
    # pandas holds integers with a missing one as floats; newer DuckDB as nullable integers
    floats = [c for c in cols if pd.api.types.is_extension_array_dtype(df[c].dtype) and pd.api.types.is_integer_dtype(df[c].dtype)
              and df[c].isna().any()]
    df = df.astype({c: float for c in floats})
    rows = sorted("|".join(_cell(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(df), cols, h, rows


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from recspark.plans import oracle_sql, queries
    from recspark.session import get_spark

    spark = get_spark(shuffle_partitions=8)
    qs, sqls = queries(), oracle_sql()
    names = args.names or list(qs)
    con = duck(args.sf)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, args.sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS-ONLY  {name}: rows={len(sdf)} cols={list(sdf.columns)} {ts:.1f}s")
            continue
        try:
            ddf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL   {name}: {str(e)[:600]}")
            bad += 1
            continue
        a, b = frame_hash(sdf), frame_hash(ddf)
        if a[:3] == b[:3]:
            print(f"OK         {name}: rows={a[0]} {ts:.1f}s")
            continue
        bad += 1
        print(f"MISMATCH   {name}: spark rows={a[0]} cols={a[1]} | duck rows={b[0]} cols={b[1]}")
        sa, sb = set(a[3]), set(b[3])
        for r in list(sa - sb)[:3]:
            print("   spark only:", r[:300])
        for r in list(sb - sa)[:3]:
            print("   duck only: ", r[:300])
    spark.stop()
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
