"""Run registered queries in Spark and their oracle SQL in DuckDB and compare them.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Checks row count, column names, and an order-insensitive hash of the values as Python sees
them (so an integer never equals a float or a string).
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(v)


def digest(columns: list[str], rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    ok_cols = sorted(scols) == sorted(dcols)
    ok_n = len(srows) == len(drows)
    ok_hash = ok_cols and digest(scols, srows) == digest(dcols, drows)
    return dict(name=name, ok=ok_cols and ok_n and ok_hash, rows=(len(srows), len(drows)),
                cols=ok_cols, hash=ok_hash, spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2),
                scols=scols, dcols=dcols, sample=(srows[:2], drows[:2]))


def main():
    from __spark_entry__ import oracle_sql, queries
    from cosignal.session import get_spark

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=int(os.environ.get("SHUFFLE_PARTITIONS", "8")), extra={"spark.driver.memory": os.environ.get("DRIVER_MEM", "8g"), "spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            df = fn(spark, sf_dir)
            print(f"{name}: rows-only {df.count()}")
            continue
        r = compare(spark, con, name, fn, sqls[name], sf_dir)
        bad += not r["ok"]
        flag = "OK " if r["ok"] else "BAD"
        print(f"{flag} {name} rows={r['rows']} cols={r['cols']} hash={r['hash']} "
              f"spark={r['spark_s']}s duck={r['duck_s']}s")
        if not r["ok"]:
            print("   ", r["scols"], r["dcols"])
            print("   ", r["sample"])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
