"""Compare queries with their SQL counterparts on one scale factor.

    python -m suite.check [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from evalflow.session import build_session
from suite.views import TABLES


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return bool(got), f"{len(got)} rows (no SQL) {took:.1f}s"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want = _rows(columns, res.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return True, f"{len(got)} rows {took:.1f}s"
    missing = [r for r in want if r not in set(got)][:2]
    extra = [r for r in got if r not in set(want)][:2]
    return False, f"{len(got)} vs {len(want)} rows\n   spark {str(extra)[:900]}\n   duck  {str(missing)[:900]}"


def main() -> int:
    from suite import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
