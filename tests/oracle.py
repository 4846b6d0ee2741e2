"""Compare registered queries with their SQL run by DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else ("n", round(v, 6))
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, con, sf_dir, plan, sql):
    """Return (rows, seconds, problem or None)."""
    start = time.time()
    df = plan(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    order = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in got)
    if sql is None:
        return len(got), seconds, None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != order:
        return len(got), seconds, f"columns {order} vs {sorted(names)}"
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in want)
    if mine != theirs:
        a, b = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
        return len(got), seconds, f"rows {len(got)} vs {len(want)}\n   spark {a}\n   sql   {b}"
    return len(got), seconds, None


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = "0.01"
    if argv and argv[0].startswith("sf"):
        sf = argv.pop(0)[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = []
    for name, plan in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            rows, seconds, problem = compare(spark, con, sf_dir, plan, sqls.get(name))
        except Exception as e:  # report and go on
            rows, seconds, problem = -1, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        flag = "ok " if problem is None else "BAD"
        note = "" if name in sqls else " (rows only)"
        print(f"{flag} {name:42s} {rows:7d} rows {seconds:6.2f}s{note}", flush=True)
        if problem:
            print("   ", problem[:1500], flush=True)
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
