"""Compare registered queries with their SQL in DuckDB.

``python tests/oracle.py [--sf DIR] [name-prefix …]``
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return int(value) if value == value.to_integral() else float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sql is None:
        return None, len(got[1]), kinds, {}
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = {c[0]: str(c[1]) for c in cur.description}
    want = rows_of(names, cur.fetchall())
    if got == want:
        return "", len(got[1]), kinds, theirs
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), kinds, theirs
    a, b = set(got[1]), set(want[1])
    return f"{len(got[1])} vs {len(want[1])} rows; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}", len(got[1]), kinds, theirs


_KIND = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def main():
    from pictorium.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf, args = args[1], args[2:]
    spark = local_session(8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    import __spark_entry__ as entry

    sql = entry.oracle_sql()
    for name, run in entry.queries().items():
        if args and not any(name == p or name.startswith(p) for p in args):
            continue
        t = time.time()
        try:
            problem, n, kinds, theirs = compare(spark, con, sf, run, sql.get(name))
        except Exception as error:  # report and go on
            problem, n, kinds, theirs = f"{type(error).__name__}: {str(error)[:1500]}", -1, {}, {}
        odd = {c: (k, theirs[c]) for c, k in kinds.items() if c in theirs and _KIND.get(k, k) != theirs[c]}
        state = "rows" if problem is None else "ok" if not problem else "BAD"
        bad += state == "BAD"
        print(f"{state:4} {name:32} {n:7} rows {time.time() - t:6.2f}s {problem or ''} {('types ' + str(odd)) if odd else ''}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
