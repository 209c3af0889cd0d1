"""Run registered queries on Spark and their oracles on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names, a coarse type class per column and the
multiset of rows (doubles compared after rounding to 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def type_class(t: str) -> str:
    t = t.lower()
    for k, names in {
        "int": ("int", "long", "bigint", "short", "tinyint", "smallint", "hugeint"),
        "float": ("double", "float", "real", "decimal"),
        "str": ("string", "varchar", "char"),
        "bool": ("bool",),
        "date": ("date",),
        "ts": ("timestamp",),
    }.items():
        if any(t.startswith(n) for n in names):
            return k
    return t


def compare(spark, sf_dir: str, names=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries

    qs, ors = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = [(f.name, type_class(f.dataType.simpleString())) for f in df.schema.fields]
            s_rows = [tuple(norm(x) for x in r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:500])
            if verbose:
                print(f"{name}: SPARK_ERROR {str(e)[:500]}")
            continue
        ts = time.time() - t0
        if name not in ors:
            results[name] = ("NO_ORACLE", len(s_rows))
            if verbose:
                print(f"{name}: no oracle, {len(s_rows)} rows, {ts:.1f}s")
            continue
        try:
            cur = con.execute(ors[name])
            d_cols = [(d[0], type_class(str(d[1]))) for d in cur.description]
            d_rows = [tuple(norm(x) for x in r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("ORACLE_ERROR", str(e)[:500])
            if verbose:
                print(f"{name}: ORACLE_ERROR {str(e)[:500]}")
            continue
        problems = []
        if [c for c, _ in s_cols] != [c for c, _ in d_cols]:
            problems.append(f"columns spark={s_cols} duck={d_cols}")
        elif s_cols != d_cols:
            problems.append(f"types spark={s_cols} duck={d_cols}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
        if sorted(s_rows, key=key) != sorted(d_rows, key=key):
            sa, da = set(s_rows), set(d_rows)
            problems.append(f"values differ: spark-only={list(sa - da)[:2]} duck-only={list(da - sa)[:2]}")
        results[name] = ("OK" if not problems else "MISMATCH", problems, len(s_rows))
        if verbose:
            print(f"{name}: {'OK' if not problems else 'MISMATCH'} rows={len(s_rows)} {ts:.1f}s {problems}")
    return results


if __name__ == "__main__":
    from stridelake.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "NO_ORACLE")]
    print("SUMMARY", len(res), "queries;", "bad:", bad)
