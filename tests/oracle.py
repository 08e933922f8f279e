"""Side-by-side check of registered queries against their SQL in DuckDB."""
from __future__ import annotations

import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in data)


def compare(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        g, w = set(got[1]), set(want[1])
        extra, missing = sorted(g - w)[:3], sorted(w - g)[:3]
        return f"{name}: {len(got[1])} vs {len(want[1])} rows {got[0]}\n  spark only {extra}\n  sql only {missing}"[:3000]
    if not got[1]:
        return f"{name}: no rows on either side"
    return None


def main(folder, pattern=""):
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from binlake import session
    spark = session.build("local[8]", shuffle_partitions=8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad, sqls = 0, entry.oracle_sql()
    for name, q in entry.queries().items():
        if not any(p in name for p in pattern.split(",")):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, folder, name, q, sqls[name])
            else:
                n = q(spark, folder).count()
                msg = None if n else f"{name}: empty"
        except Exception:
            msg = f"{name}: {traceback.format_exc()[-1800:]}"
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in sqls else '(rows only)'}", flush=True)
        if msg:
            print(msg, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
