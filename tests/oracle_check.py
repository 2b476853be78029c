"""Side-by-side check of a Spark query against its DuckDB SQL twin
(row count, column names, order-insensitive values) — the same comparison
the driver performs, usable from tests and from the command line:

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=False))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    data = rel.fetchall()
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=repr)


def compare(spark, sf_dir, name, query, sql, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sc, sr = rows_of_spark(query(spark, sf_dir))
    t1 = time.time()
    dc, dr = rows_of_duck(con, sql)
    t2 = time.time()
    ok = sc == dc and sr == dr
    info = dict(name=name, ok=ok, spark_rows=len(sr), duck_rows=len(dr), spark_s=round(t1 - t0, 2),
                duck_s=round(t2 - t1, 2))
    if not ok:
        info["spark_cols"], info["duck_cols"] = sc, dc
        diff_s = [r for r in sr if r not in set(dr)][:2]
        diff_d = [r for r in dr if r not in set(sr)][:2]
        info["only_spark"] = repr(diff_s)[:600]
        info["only_duck"] = repr(diff_d)[:600]
    return info


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from lexeval.session import get_spark
    sf_dir = argv[0] if argv and os.path.isdir(argv[0]) else "/root/testdata/sf0.01"
    names = [a for a in argv if not os.path.isdir(a)]
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in names or list(qs):
        if n not in sqls:
            df = qs[n](spark, sf_dir)
            print({"name": n, "rows_only": df.count()}, flush=True)
            continue
        info = compare(spark, sf_dir, n, qs[n], sqls[n], con)
        bad += not info["ok"]
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
