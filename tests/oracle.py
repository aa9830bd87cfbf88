"""Run registered queries against their DuckDB twins: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, int):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, root, q):
    start = time.time()
    df = q.run(spark, root)
    cols, got = rows_of(df.columns, df.collect())
    took = f" spark {time.time() - start:.2f}s"
    if q.sql is None:
        return True, f"{len(got)} rows (no oracle){took}"
    cur = con.execute(q.sql)
    ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return False, f"columns {cols} != {ocols}"
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 20000 else "?"
        missing = [r for r in want if r not in got][:3] if len(want) < 20000 else "?"
        return False, f"rows {len(got)} vs {len(want)}\n   spark only: {str(extra)[:900]}\n   duckdb only: {str(missing)[:900]}"
    return True, f"{len(got)} rows{took}"


def main():
    from evidence_spark.session import get_spark
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.001"
    root = f"/root/testdata/sf{sf}"
    wanted = set(args)
    entry.queries()
    from evidence_spark.plans.registry import QUERIES

    spark = get_spark("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                               "spark.driver.memory": "12g", "spark.sql.debug.maxToStringFields": "50"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    bad = []
    for name, q in QUERIES.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) or w == q.run.__module__ for w in wanted):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, root, q)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name} {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
