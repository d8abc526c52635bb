"""Run registered queries and compare them with their SQL: python tests/oracle_check.py [sf] [name part ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(canon(r[k]) for k in order) for r in data)


def compare(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    cols, mine = rows_of(df.columns, got)
    if sql is None:
        return ("rows", len(mine), spent, 0.0, "")
    t = time.time()
    cur = con.execute(sql)
    ocols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    osec = time.time() - t
    if cols != ocols:
        return ("COLUMNS", len(mine), spent, osec, f"{cols} vs {ocols}")
    if mine == theirs:
        return ("ok" if mine else "EMPTY", len(mine), spent, osec, "")
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return ("DIFF", len(mine), spent, osec, f"{len(mine)} vs {len(theirs)} rows; {len(diff)} differ; {diff[:2]}")


def main():
    from tremora.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            status, n, s, o, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            status, n, s, o, note = "ERROR", 0, 0, 0, str(e)[:600]
        bad += status not in ("ok", "rows")
        print(f"{status:8s} {name:34s} n={n:<7d} spark={s:5.1f}s sql={o:5.1f}s {note[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
