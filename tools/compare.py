"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and order-insensitive values.

    python tools/compare.py [sf_dir] [key-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tagweave.plans.registry import load_all  # noqa: E402
from tagweave.session import build_session  # noqa: E402
from tagweave.sources.tables import TABLE_NAMES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


SPARK_TO_DUCK = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP", "FloatType": "FLOAT",
                 "ShortType": "SMALLINT", "ByteType": "TINYINT", "DateType": "DATE"}


def type_mismatches(sdf, res):
    duck = {d[0]: str(d[1]) for d in res.description}
    out = []
    for f in sdf.schema.fields:
        st = SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
        dt = duck.get(f.name, "?")
        if st != dt and not (st == "VARCHAR" and dt == "JSON"):
            out.append(f"{f.name}: spark {st} duck {dt}")
    return out


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    queries = load_all()
    ok = bad = 0
    for key, q in queries.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf_dir)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: spark error {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"ROWS {key}: {len(srows)} rows (no oracle) {ts:.1f}s")
            ok += 1
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {key}: columns spark={cols} duck={dcols}")
            bad += 1
            continue
        a, b = rows_of(cols, srows), rows_of(dcols, drows)
        tm = type_mismatches(df, res)
        if a == b and tm:
            print(f"TYPE {key}: values equal, types differ {tm}")
            bad += 1
        elif a == b:
            print(f"OK   {key}: {len(a)} rows {ts:.1f}s")
            ok += 1
        else:
            print(f"FAIL {key}: spark {len(a)} rows, duck {len(b)} rows")
            sa, sb = set(a), set(b)
            print("   only spark:", [str(x)[:300] for x in list(sa - sb)[:3]])
            print("   only duck: ", [str(x)[:300] for x in list(sb - sa)[:3]])
            bad += 1
    print(f"{ok} ok, {bad} failed")


if __name__ == "__main__":
    main()
