"""Run registered queries next to their SQL and compare rows: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Empty string if equal, else the first difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}"
    return ""


def main():
    from __spark_entry__ import oracle_sql, queries
    from pluvio.session import build_session
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    only = args[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                why = compare(df, con, sqls[name])
            else:
                why = "" if df.collect() else "no rows"
        except Exception as err:  # report and go on
            why = f"{type(err).__name__}: {str(err)[:1200]}"
        print(f"{'ok  ' if not why else 'FAIL'} {name} {time.time() - t:.1f}s {'' if name in sqls else '(rows only)'} {why}", flush=True)
        if why:
            failed.append(name)
    print("failed:", failed)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
