"""Run registered queries against their SQL in DuckDB: python tests/oracle_check.py SF [key ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool):
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in records)


def compare(spark, con, sf_dir, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    table = df.toArrow()
    spark_s = time.time() - t
    left = rows_of(df.columns, list(zip(*[c.to_pylist() for c in table.columns])) or [])
    if sql is None:
        return len(left[1]), None, "no sql", spark_s
    t = time.time()
    cur = con.execute(sql)
    right = rows_of([c[0] for c in cur.description], cur.fetchall())
    duck_s = time.time() - t
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_kinds = {c[0]: str(c[1]) for c in cur.description}
    if left == right:
        return len(left[1]), len(right[1]), "ok", spark_s, duck_s, kinds, duck_kinds
    detail = f"DIFF columns {left[0]} vs {right[0]}" if left[0] != right[0] else ""
    ls, rs = set(left[1]), set(right[1])
    detail = detail or f"DIFF {len(ls - rs)} only spark, {len(rs - ls)} only sql\n   " + "\n   ".join(
        f"{k}:{r}" for k, s in (("spark", ls - rs), ("sql", rs - ls)) for r in sorted(s)[:3])
    return len(left[1]), len(right[1]), detail, spark_s, duck_s, kinds, duck_kinds


def main() -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in sys.argv[2:] or list(queries):
        try:
            out = compare(spark, con, sf_dir, queries[key], sqls.get(key))
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{key:22} ERROR {type(e).__name__}: {str(e)[:500]}", flush=True)
            continue
        ok = out[2] in ("ok", "no sql")
        bad += not ok
        times = " ".join(f"{x:.1f}s" for x in out[3:5])
        print(f"{key:22} {out[0]:>8} {str(out[1]):>8} {times:>12} {out[2]}", flush=True)
        if ok and len(out) > 5:
            pairs = {k: (v, out[6].get(k)) for k, v in out[5].items()}
            same = {"string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "int": "INTEGER",
                    "bigint": "BIGINT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
            odd = {k: v for k, v in pairs.items() if same.get(v[0]) != v[1]}
            if odd:
                print(f"{'':22} types: {odd}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
