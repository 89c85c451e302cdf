"""Run registered queries next to their SQL: python tools/check.py [sf] [name prefix ...]"""

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barline.plans import catalog  # noqa: E402
from barline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return str(v)


def compare(spark, con, name, folder):
    df = catalog.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in catalog.ORACLE:
        return "rows-only", f"{len(got)} rows"
    rel = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return "BAD", f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    types_a = [type(v).__name__ for v in next(iter(got), ())]
    a, b = sorted(tuple(map(canon, r)) for r in got), sorted(tuple(map(canon, r)) for r in want)
    if a == b:
        return ("ok" if a else "EMPTY"), f"{len(a)} rows"
    bad_a, bad_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    n = len(set(a) ^ set(b))
    return "BAD", f"{len(a)} vs {len(b)} rows, {n} differ\n   cols {cols} {types_a}\n   spark {bad_a}\n   sql   {bad_b}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    catalog.load_all()
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session("8", scratch=tempfile.mkdtemp(prefix="barline-check-")), connect(folder)
    tally = {}
    for name in catalog.QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            status, note = compare(spark, con, name, folder)
        except Exception as e:
            status, note = "FAIL", f"{type(e).__name__}: {str(e)[:700]}"
        tally[status] = tally.get(status, 0) + 1
        print(f"{status:9} {name:34} {time.time() - t0:6.2f}s {note}", flush=True)
    print(tally)
    spark.stop()


if __name__ == "__main__":
    main()
