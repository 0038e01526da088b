"""Compare queries with their SQL twins: ``python tests/oracle.py [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(mine)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(mine)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}", len(mine)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return (f"{len(bad)} rows differ, e.g. {bad[0][0]} against {bad[0][1]}" if bad else None), len(mine)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from duelstats.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if len(sys.argv) > 1 and not any(part in name for part in sys.argv[1:]):
            continue
        start = time.time()
        try:
            wrong, rows = compare(spark, con, fn, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            wrong, rows = f"{type(e).__name__}: {str(e)[:600]}", 0
        print(f"{'BAD ' if wrong else 'ok  '}{name} rows={rows} {time.time() - start:.1f}s {'' if name in oracles else '(no sql)'} {wrong or ''}", flush=True)
        if wrong:
            failed.append(name)
    print("failed:", failed)
