"""Run registered queries and their oracles side by side and compare them strictly.

usage: python tools/check_oracles.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetsight.plans.catalog import ORACLES, QUERIES  # noqa: E402
from fleetsight.session import local_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{os.path.join(sf_dir, f)}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None:
            return ("null",)
        if isinstance(v, bool):
            return ("bool", v)
        if isinstance(v, int):
            return ("num", float(v))
        if isinstance(v, float):
            return ("null",) if math.isnan(v) else ("num", v)
        return (type(v).__name__, v)

    return sorted(columns), sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def compare(con, spark, name: str, sf_dir: str):
    """(ok, rows, message) for one query."""
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return True, len(got[1]), "rows only"
    cur = con.execute(ORACLES[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, len(got[1]), f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return (not bad), len(got[1]), (f"{len(bad)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}" if bad else "")


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    failed = []
    for name in sorted(QUERIES):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, n, message = compare(con, spark, name, sf_dir)
        except Exception as exc:  # report and go on
            ok, n, message = False, -1, f"{type(exc).__name__}: {str(exc)[:300]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} rows={n:6d} {time.time() - start:6.2f}s {message}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
